"""Queries by name over the derived records, and the SQL that each must agree with.

Every query starts from the whole table ``documents`` and runs its operator on all
the records that come of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T
from linkloom.operators import blocking, context, decide, expand, features, labels, learn, validate
from linkloom.plans import oracle as O
from linkloom.sources import tsv
from linkloom.sources.records import records, truth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = O.duck(sql, *needs)
        return f

    return keep


class Base:
    """The tables that queries start from, each a lazy plan.

    Prepared records are kept for the queries over the same tables, which find them by their plan; those of other
    tables go, so that a session holds one such table.
    """

    _held: tuple[SparkSession, str, DataFrame] | None = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        if Base._held is not None and Base._held[0] is spark and Base._held[1] != sf_dir:
            Base._held[2].unpersist()
        self.spark = spark
        self.biz = records(spark, sf_dir)
        self.raw = self.biz.select("entity_id", "business_name", "business_address", "country")
        self.prep = T.prepare(self.raw).persist()  # keys, shards and features of both sides all start here
        Base._held = spark, sf_dir, self.prep
        self.left = self.prep.where("entity_id like 'S1-%'")
        self.right = self.prep.where("entity_id not like 'S1-%'")
        self.truth = truth(self.biz)

    def latin(self) -> DataFrame:
        return self.raw.select("entity_id", T.to_latin(T.clean_nulls(F.col("business_name"))).alias("n"), T.to_latin(T.clean_nulls(F.col("business_address"))).alias("a"), T.country(F.col("country")).alias("ctry"))

    def keys(self) -> tuple[DataFrame, DataFrame]:
        return blocking.keys(self.left), blocking.keys(self.right)

    def shard(self) -> DataFrame:
        return blocking.shards(self.left, self.right)

    def met(self) -> DataFrame:
        l, r = self.keys()
        return blocking.meet(l, blocking.index(r, self.shard()))

    def best(self) -> DataFrame:
        return blocking.block(self.left, self.right)

    def pairs(self) -> DataFrame:
        """Best pairs with both records and the names that the SQL features compare."""
        core = self.prep.select("entity_id", F.col("name_core").alias("_c"))
        pairs = features.joined(self.best().select("i", "j", "kscore"), self.left, self.right)
        pairs = pairs.join(core.toDF("i", "nl"), "i").join(core.toDF("j", "nr"), "j")
        return pairs

    def scored(self) -> DataFrame:
        """(i, j, kscore, p2): a score that SQL can repeat."""
        f = features.full_sql(F.col("nl"), F.col("nr"))
        p = F.round(0.5 * f["nm_jac"] + 0.3 * f["num_jac"] + 0.2 * f["ad_wjac"], 6)
        return self.pairs().select("i", "j", "kscore", p.alias("p2"))

    def exclusive(self) -> DataFrame:
        return decide.exclusive(self.scored().select("i", "j", F.col("p2").alias("p")))

    def everyone(self) -> DataFrame:
        return self.biz.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("i"))

    def true_pairs(self) -> DataFrame:
        return labels.explode_truth(self.truth)

    def lists(self) -> DataFrame:
        """A result with one fault of each kind, by the record's number."""
        good = tsv.listed(self.left, decide.select_threshold(self.exclusive(), 0.3), "matched_entity_ids")
        n = F.substring("source1_entity_id", 4, 20).cast("long")
        ids = F.col("matched_entity_ids")
        bad = F.when(n % 11 == 0, F.concat_ws(",", ids, ids)).when(n % 11 == 1, F.concat_ws(",", ids, F.lit("S1-7"))).when(n % 11 == 2, F.concat_ws(",", ids, F.lit("X-1"))).when(n % 11 == 3, F.concat_ws(",", ids, F.concat(F.lit("S2-99999999"), F.lit("")))).otherwise(ids)
        once = good.withColumn("matched_entity_ids", bad).where(n % 13 != 0)
        twice = once.where(n % 17 == 0)
        strange = once.where(n % 19 == 0).withColumn("source1_entity_id", F.concat("source1_entity_id", F.lit("9999999")))
        return validate.rows_of(once.union(twice).union(strange))


_LISTS = """lists0 as (select i, coalesce(string_agg(j, ',' order by p desc, j), '') as ids from s1 left join (select * from excl where p > 0 and p >= 0.3) using (i) group by i),
lists1 as (select i as id, cast(substr(i, 4) as bigint) as n, ids from lists0),
lists2 as (select id, n, case n % 11 when 0 then ids || ',' || ids when 1 then ids || ',S1-7' when 2 then ids || ',X-1' when 3 then ids || ',S2-99999999' else ids end as ids from lists1 where n % 13 <> 0),
lists3 as (select id, ids from lists2 union all select id, ids from lists2 where n % 17 = 0 union all select id || '9999999', ids from lists2 where n % 19 = 0),
rows_ as (select id, list_filter(string_split(ids, ','), lambda x: x <> '') as ids from lists3),
entries as (select id, unnest(ids) as entry from rows_)
"""
#: The faulty lists in SQL.
_FAULTY = O.duck("", "s1", "excl").rstrip() + ",\n" + _LISTS


def faulty(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = _FAULTY + sql
        return f

    return keep


# Sources and sinks -------------------------------------------------------------


@query("select entity_id, name_vars, ctry from prep", "prep")
def scan_records(spark, sf_dir):
    return Base(spark, sf_dir).prep.select("entity_id", "name_vars", "ctry")


@query("select entity_id, business_name from biz where entity_id like 'S2-%' or entity_id like 'S3-%'", "biz")
def union_right(spark, sf_dir):
    raw = Base(spark, sf_dir).raw
    return tsv.union_right(raw.where("entity_id like 'S2-%'"), raw.where("entity_id like 'S3-%'")).select("entity_id", "business_name")


@query("select entity_id from biz order by md5('0:' || entity_id), entity_id limit 100", "biz")
def sample_exact(spark, sf_dir):
    return tsv.sample_exact(Base(spark, sf_dir).raw.select("entity_id"), 100, "entity_id")


@query("select entity_id, case when nth <= 150 then 'T' when nth <= 200 then 'V' else 'A' end as grp from (select entity_id, row_number() over (order by md5('42:' || entity_id), entity_id) as nth from biz where entity_id like 'S1-%')", "biz")
def split_groups(spark, sf_dir):
    left = Base(spark, sf_dir).raw.where("entity_id like 'S1-%'").select("entity_id")
    return tsv.split_groups(left, {"A": 0, "T": 150, "V": 50}, "entity_id")


@query("select i as source1_entity_id, coalesce(string_agg(j, ',' order by p desc, j), '') as matched_entity_ids from s1 left join (select * from excl where p > 0 and p >= 0.3) using (i) group by i", "s1", "excl")
def write_ids(spark, sf_dir):
    b = Base(spark, sf_dir)
    return tsv.listed(b.left, decide.select_threshold(b.exclusive(), 0.3), "matched_entity_ids")


@query("select entity_id, cast(substr(entity_id, 2, 1) as bigint) * 10000000000 + cast(substr(entity_id, 4) as bigint) as id_num from biz", "biz")
def id_num(spark, sf_dir):
    return Base(spark, sf_dir).raw.select("entity_id", tsv.id_num("entity_id").alias("id_num"))


# Text ---------------------------------------------------------------------------


@query(f"select entity_id, {O.clean('business_name')} as name, {O.clean('business_address')} as address from biz", "biz")
def clean_nulls(spark, sf_dir):
    return Base(spark, sf_dir).raw.select("entity_id", T.clean_nulls(F.col("business_name")).alias("name"), T.clean_nulls(F.col("business_address")).alias("address"))


@query(f"select doc_id, {O.fold('text')} as folded from documents")
def accent_fold(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(r"select doc_id, not regexp_matches(text, '[\x{250}-\x{10FFFF}]') or not regexp_matches(regexp_replace(text, '[\x{0}-\x{24F}]', '', 'g'), '\pL') as latin from documents")
def is_latin(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.is_latin(F.col("text")).alias("latin"))


@query("select entity_id, n, a from raw1", "raw1")
def to_latin(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", "n", "a")


@query(f"select entity_id, list_transform(string_split(n, ' '), lambda t: {O.deleet('t')}) as words from raw1", "raw1")
def deleet(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", F.transform(F.split("n", " "), T.deleet).alias("words"))


@query(f"select entity_id, {O.variants('n')} as variants from raw1", "raw1")
def name_variants(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", T.variants_of(F.col("n")).alias("variants"))


@query(f"select entity_id, {O.tokens('n')} as tokens from raw1", "raw1")
def name_tokens(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", T.name_tokens(F.col("n")).alias("tokens"))


@query(f"select entity_id, {O.core('tokens')} as core from (select entity_id, {O.tokens('n')} as tokens from raw1)", "raw1")
def core_name(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", T.core(T.name_tokens(F.col("n"))).alias("core"))


@query("select entity_id, name_full, name_core, name_vars from prep", "prep")
def norm_name(spark, sf_dir):
    return Base(spark, sf_dir).prep.select("entity_id", "name_full", "name_core", "name_vars")


@query("select entity_id, cl as components from raw2", "raw2")
def addr_components(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", T.components_of(F.col("a"), F.col("ctry")).alias("components"))


@query("select entity_id, addr_n from prep", "prep")
def addr_tokens(spark, sf_dir):
    return Base(spark, sf_dir).prep.select("entity_id", "addr_n")


@query(f"select entity_id, list_transform(string_split(n, ' '), lambda t: {O.skeleton('t')}) as skeletons from raw1", "raw1")
def skeleton(spark, sf_dir):
    return Base(spark, sf_dir).latin().select("entity_id", F.transform(F.split("n", " "), T.skeleton).alias("skeletons"))


@query("select ctry, count(*) as n from prep group by ctry", "prep")
def country_norm(spark, sf_dir):
    return Base(spark, sf_dir).prep.groupBy("ctry").agg(F.count("*").alias("n"))


# Learned dictionaries ------------------------------------------------------------


@query("select i, j from truth_", "truth_")
def explode_truth(spark, sf_dir):
    return Base(spark, sf_dir).true_pairs()


#: Renderings of another script: each Latin name in a made-up alphabet of Greek letters, shifted for every third record.
_LATIN, _GREEK, _OTHER = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωϗϙ", "βαδγζεθηκιμλξνποσρυτχφωψϙϗ"


def _greek(b: Base) -> DataFrame:
    """True pairs with the right name in Greek letters."""
    name = F.when(tsv.id_num("entity_id") % 3 == 0, F.translate(F.lower("business_name"), _LATIN, _OTHER)).otherwise(F.translate(F.lower("business_name"), _LATIN, _GREEK))
    right = b.raw.where("entity_id not like 'S1-%'").withColumn("business_name", name)
    return learn.labelled_records(b.raw.where("entity_id like 'S1-%'"), right, b.truth)


_ALIGN = f"""
, g as (select t.i, t.j, lower(l.business_name) as nl, case when (cast(substr(t.j, 2, 1) as bigint) * 10000000000 + cast(substr(t.j, 4) as bigint)) % 3 = 0
    then translate(lower(r.business_name), '{_LATIN}', '{_OTHER}') else translate(lower(r.business_name), '{_LATIN}', '{_GREEK}') end as nr
    from truth_ t join biz l on l.entity_id = t.i join biz r on r.entity_id = t.j),
w as (select list_filter(regexp_split_to_array(nl, '\\s+'), lambda x: x <> '') as a, list_filter(regexp_split_to_array(nr, '\\s+'), lambda x: x <> '') as b from g),
z as (select b[k] as token, regexp_replace(a[k], '^[.,()]+|[.,()]+$', '', 'g') as target from (select *, unnest(range(1, len(a) + 1)) as k from w where len(a) = len(b))),
aligned as (select token, target, count(*) as n from z where regexp_matches(token, '[\\x{{370}}-\\x{{3ff}}]') group by token, target)
"""


def _aligned(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = O.duck("", "truth_", "biz").rstrip() + _ALIGN + sql
        return f

    return keep


@_aligned("select token, target, n from aligned")
def token_align(spark, sf_dir):
    return learn.token_align(_greek(Base(spark, sf_dir)))


@_aligned("select token, target, n from (select *, row_number() over (partition by token order by n desc, target) as nth, sum(n) over (partition by token) as total from aligned) where nth = 1 and n >= 3 and n / total >= 0.5")
def learn_translit(spark, sf_dir):
    return learn.learn_translit(learn.token_align(_greek(Base(spark, sf_dir))))


_COOC = """
, parts as (select t.i, t.j, list_distinct(list_filter(list_transform(string_split({l}, ','), lambda p: trim(p)), lambda p: p <> '')) as a,
    list_distinct(list_filter(list_transform(string_split({r}, ','), lambda p: trim(p)), lambda p: p <> '')) as b
    from truth_ t join biz l on l.entity_id = t.i join biz r on r.entity_id = t.j),
fresh as (select a, c from (select a, unnest(b) as c from parts) where not list_contains(a, c) and len(c) <= 3),
cn as (select c, count(*) as comp_n from fresh group by c),
ln_ as (select c, count(*) as left_n from (select distinct i, unnest(a) as c from parts) group by c),
cooc as (select c, t, n, comp_n, coalesce(left_n, 0) as left_n from (select c, t, count(*) as n from (select c, unnest(a) as t from fresh) group by c, t) join cn using (c) left join ln_ using (c))
""".format(l=O.fold(O.clean("l.business_address || ', ' || substr(l.business_name, 1, 3)")), r=O.fold(O.clean("r.business_address || ', ' || substr(r.country, 1, 3) || ', ' || substr(r.nm, 1, 2)")))


def _coded(b: Base) -> DataFrame:
    """True pairs whose addresses end in short codes."""
    left = b.raw.where("entity_id like 'S1-%'").withColumn("business_address", F.concat("business_address", F.lit(", "), F.substring("business_name", 1, 3)))
    right = b.biz.where("entity_id not like 'S1-%'").withColumn("business_address", F.concat("business_address", F.lit(", "), F.substring("country", 1, 3), F.lit(", "), F.substring("nm", 1, 2)))
    return learn.labelled_records(left, right.select(*b.raw.columns), b.truth)


def _cooccurring(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = O.duck("", "truth_", "biz").rstrip() + _COOC + sql
        return f

    return keep


@_cooccurring("select c, t, n, comp_n, left_n from cooc")
def component_cooc(spark, sf_dir):
    return learn.component_cooc(_coded(Base(spark, sf_dir)))


@_cooccurring("select c as component, t as target, n from (select *, row_number() over (partition by c order by n desc, t) as nth from cooc where comp_n >= 20 and left_n <= 0.05 * comp_n) where nth = 1 and n / comp_n >= 0.1")
def learn_component(spark, sf_dir):
    return learn.learn_component(learn.component_cooc(_coded(Base(spark, sf_dir))), min_share=0.1)


# Blocking ------------------------------------------------------------------------


@query("select entity_id, ctry, key from keys_", "keys_")
def block_keys(spark, sf_dir):
    return blocking.keys(Base(spark, sf_dir).prep)


@query("select ctry, n_right from shard", "shard")
def block_shard(spark, sf_dir):
    return Base(spark, sf_dir).shard()


@query("select ctry, key, df from kdf", "kdf")
def stop_keys(spark, sf_dir):
    right = Base(spark, sf_dir).keys()[1]
    return right.groupBy("ctry", "key").agg(F.count("*").alias("df")).where(F.col("df") <= blocking.MAX_DF)


@query("select ctry, key, df, round(idf, 6) as idf from kidf", "kidf")
def key_idf(spark, sf_dir):
    b = Base(spark, sf_dir)
    return blocking.weights(b.keys()[1], b.shard()).select("ctry", "key", "df", F.round("idf", 6).alias("idf"))


@query("select i, j, count(*) as n_keys from met group by i, j", "met")
def block_join(spark, sf_dir):
    return Base(spark, sf_dir).met().groupBy("i", "j").agg(F.count("*").alias("n_keys"))


@query("select i, j, kscore from scores", "scores")
def block_score(spark, sf_dir):
    return blocking.score(Base(spark, sf_dir).met())


@query("select i, j, kscore, rank from best", "best")
def block_topk(spark, sf_dir):
    return Base(spark, sf_dir).best().select("i", "j", "kscore", F.col("rank").cast("long").alias("rank"))


@query("select a, n, score from near", "near")
def neighbours(spark, sf_dir):
    return blocking.neighbours(Base(spark, sf_dir).right)


# Similarity and features ---------------------------------------------------------


def _named_pairs(spark, sf_dir) -> DataFrame:
    return Base(spark, sf_dir).pairs()


@query()
def sim_ratio(spark, sf_dir):
    return _named_pairs(spark, sf_dir).select("i", "j", S.ratio_col("nl", "nr").alias("ratio"), S.token_sort_col("nl", "nr").alias("token_sort"))


@query()
def sim_token_set(spark, sf_dir):
    return _named_pairs(spark, sf_dir).select("i", "j", S.token_set_col("nl", "nr").alias("token_set"), S.partial_col("nl", "nr").alias("partial"), S.partial_token_set_col("addr_n_l", "addr_n_r").alias("partial_token_set"))


@query("select i, j, round(jaro_winkler_similarity(nl, nr), 6) as jw from pairs", "pairs")
def sim_jaro_winkler(spark, sf_dir):
    return _named_pairs(spark, sf_dir).select("i", "j", F.round(S.jaro_winkler_col("nl", "nr"), 6).alias("jw"))


@query("select i, j, levenshtein(nl, nr) as lev from pairs", "pairs")
def sim_levenshtein(spark, sf_dir):
    return _named_pairs(spark, sf_dir).select("i", "j", F.levenshtein("nl", "nr").cast("long").alias("lev"))


@query(f"select i, j, round({O.jaccard('tl', 'tr')}, 6) as jac from lists", "lists")
def sim_jaccard(spark, sf_dir):
    return _named_pairs(spark, sf_dir).select("i", "j", F.round(S.jaccard(blocking.words(F.col("nl")), blocking.words(F.col("nr"))), 6).alias("jac"))


_INTER = "len(list_intersect({}, {}))::double"
_FIRST = "regexp_extract({}, '^([0-9]+)( |$)', 1)"
_FEATURES = {
    "nm_lev": "levenshtein(nl, nr)::double", "nm_jac": O.jaccard("tl", "tr"), "nm_inter": _INTER.format("tl", "tr"), "nm_ntok_l": "len(list_distinct(tl))::double", "nm_ntok_r": "len(list_distinct(tr))::double",
    "nm_len_l": "len(nl)::double", "nm_len_r": "len(nr)::double", "nm_first_eq": "(tl[1] is not distinct from tr[1])::int::double", "nm_eq": "(replace(nl, ' ', '') = replace(nr, ' ', ''))::int::double",
    "nv_multi": "contains(vr, '|')::int::double", "ad_len_l": "len(al)::double", "ad_len_r": "len(ar)::double", "ad_wjac": O.jaccard("wl", "wr"),
    "ad_wcov": f"case when len(wr) > 0 then {_INTER.format('wl', 'wr')} / len(wr) else -1.0 end", "num_jac": O.jaccard("dl", "dr"), "num_inter": _INTER.format("dl", "dr"), "num_r": "len(dr)::double",
    "num_conflict": f"(len(dl) > 0 and len(dr) > 0 and {_INTER.format('dl', 'dr')} = 0)::int::double",
    "num_first_eq": f"case when {_FIRST.format('al')} = '' or {_FIRST.format('ar')} = '' then -1.0 else ({_FIRST.format('al')} = {_FIRST.format('ar')})::int::double end",
    "comp_jac": O.jaccard("kl", "kr"), "comp_inter": _INTER.format("kl", "kr"), "comp_n_r": "len(kr)::double", "src3": "starts_with(j, 'S3')::int::double",
}


@query("select i, j, " + ", ".join(f"round({v}, 6) as {k}" for k, v in _FEATURES.items()) + " from sets", "sets")
def pair_features_sql(spark, sf_dir):
    f = features.full_sql(F.col("nl"), F.col("nr"))
    return _named_pairs(spark, sf_dir).select("i", "j", *[F.round(v, 6).alias(k) for k, v in f.items()])


@query()
def pair_features_fuzzy(spark, sf_dir):
    b = Base(spark, sf_dir)
    return features.pair_features(b.best().select("i", "j", "kscore"), b.left, b.right).select("i", "j", *features.FULL)


@query()
def cheap_features(spark, sf_dir):
    b = Base(spark, sf_dir)
    return features.cheap_features(b.best().select("i", "j", "kscore"), b.left, b.right).select("i", "j", *features.CHEAP)


# Windows -------------------------------------------------------------------------


@query("select i, j, kscore, (row_number() over (partition by i order by kscore desc, j) - 1)::double as k_rank, round(max(kscore) over (partition by i) - kscore, 6) as k_gap, round(kscore / greatest(max(kscore) over (partition by i), 1e-6), 6) as k_rel, count(*) over (partition by i)::double as k_n from best", "best")
def k_context(spark, sf_dir):
    df = context.k_context(Base(spark, sf_dir).best().select("i", "j", "kscore"))
    return df.withColumns({"k_gap": F.round("k_gap", 6), "k_rel": F.round("k_rel", 6)})


@query("select i, j, round(max(p2) over (partition by i) - p2, 6) as c_ctx_gap, row_number() over (partition by i order by p2 desc, kscore desc, j)::double as c_ctx_rank from scored", "scored")
def stage2_context(spark, sf_dir):
    df = context.name_context(Base(spark, sf_dir).scored(), F.col("p2"))
    return df.select("i", "j", F.round("c_ctx_gap", 6).alias("c_ctx_gap"), "c_ctx_rank")


@query("""select i, j, p2, row_number() over (partition by i order by p2 desc, kscore desc, j)::double as i_rank, round(max(p2) over (partition by i) - p2, 6) as i_gap, count(*) over (partition by i)::double as i_n,
    round(sum(cast(p2 as decimal(20, 12))) over (partition by i)::double, 6) as i_sum, row_number() over (partition by j order by p2 desc, i)::double as j_rank, round(max(p2) over (partition by j) - p2, 6) as j_gap, count(*) over (partition by j)::double as j_n from scored""", "scored")
def competition(spark, sf_dir):
    df = context.competition(Base(spark, sf_dir).scored())
    return df.select("i", "j", "p2", "i_rank", F.round("i_gap", 6).alias("i_gap"), "i_n", F.round("i_sum", 6).alias("i_sum"), "j_rank", F.round("j_gap", 6).alias("j_gap"), "j_n")


@query("""select i, j, round(case when nth = 1 then p2 - coalesce(second, 0) else p2 - top end, 6) as j_margin from (select i, j, p2, row_number() over (partition by j order by p2 desc, i) as nth,
    nth_value(p2, 2) over (partition by j order by p2 desc, i rows between unbounded preceding and unbounded following) as second, max(p2) over (partition by j) as top from scored)""", "scored")
def j_margin(spark, sf_dir):
    return context.j_margin(Base(spark, sf_dir).scored()).select("i", "j", F.round("j_margin", 6).alias("j_margin"))


@query("select i, j, p2 from (select *, row_number() over (partition by i order by p2 desc, kscore desc, j) as nth from scored) where nth <= 12", "scored")
def prune_topk(spark, sf_dir):
    return context.top_by(Base(spark, sf_dir).scored(), 12).select("i", "j", "p2")


# Labels and learned stages -------------------------------------------------------


@query("select b.i, b.j, t.i is not null as y from best b left join truth_ t using (i, j)", "best", "truth_")
def label_pairs(spark, sf_dir):
    b = Base(spark, sf_dir)
    return labels.label_pairs(b.best().select("i", "j"), b.true_pairs())


@query("""select n_pairs, n_found, n_true, round(n_pairs / n_left, 6) as pairs_per_left, round(n_found / n_true, 6) as recall from (select count(*) as n_pairs, count(t.i) as n_found from best b left join truth_ t using (i, j)),
    (select count(*) as n_true from truth_), (select count(*) as n_left from s1)""", "best", "truth_", "s1")
def blocking_recall(spark, sf_dir):
    b = Base(spark, sf_dir)
    return labels.recall(labels.label_pairs(b.best().select("i", "j"), b.true_pairs()), b.true_pairs(), b.left)


@query("select p2 as tau from (select p2, row_number() over (order by p2) as nth, count(*) over () as n from scored join truth_ using (i, j)) where nth = floor(0.003 * n) + 1", "scored", "truth_")
def tau_order_stat(spark, sf_dir):
    b = Base(spark, sf_dir)
    return labels.order_statistic(b.scored().join(b.true_pairs(), ["i", "j"], "left_semi"), "p2", 0.003)


@query("""select i, j, p2 from (select i, j, p2, row_number() over (partition by i order by p2 desc, kscore desc, j) as nth from (
    select i, j, kscore, case when cast(substr(i, 4) as bigint) % 5 = 0 then round(p2 / 2, 6) else p2 end as p2 from scored) where p2 >= 0.2) where nth <= 12""", "scored")
def prune(spark, sf_dir):
    from linkloom.operators.model import prune as cut

    oof = F.when(F.substring("i", 4, 20).cast("long") % 5 == 0, F.round(F.col("p2") / 2, 6))
    return cut(Base(spark, sf_dir).scored().withColumn("oof", oof), 0.2, 12, "oof").select("i", "j", "p2")


@query("select i, (cast(substr(i, 2, 1) as bigint) * 10000000000 + cast(substr(i, 4) as bigint)) * 7919 % 3 as fold from s1", "s1")
def cross_folds(spark, sf_dir):
    return Base(spark, sf_dir).everyone().select("i", labels.fold_of("i").cast("long").alias("fold"))


_F05 = """coalesce(case when t = 0 and n = 0 then 1.0 when tp = 0 then 0.0 else 1.25 * (tp / n) * (tp / t) / (0.25 * (tp / n) + tp / t) end, 0)"""
_JUDGED = """select s.i{by}, coalesce(t.t, 0) as t, coalesce(c.n, 0) as n, coalesce(c.tp, 0) as tp from s1 s {cross} left join (select i, count(*) as t from truth_ group by i) t using (i)
    left join (select {keys}i, count(*) as n, count(y) as tp from {chosen} left join (select i, j, 1 as y from truth_) using (i, j) group by {keys}i) c using ({keys}i)"""


@query(f"""select mode, tau, round(avg({_F05}), 6) as f05, count(*) as n from ({_JUDGED.format(by=', g.mode, g.tau', cross='cross join (select mode, tau::double as tau from grid) g', keys='mode, tau, ',
    chosen="(select 'thr' as mode, g.tau, i, j from excl, (select distinct tau::double as tau from grid) g where p > 0 and p >= g.tau union all select 'exp', tau, i, j from chosen)")}) group by mode, tau""", "s1", "truth_", "excl", "chosen", "grid")
def decision_grid(spark, sf_dir):
    b = Base(spark, sf_dir)
    return decide.grid(b.exclusive(), b.true_pairs(), b.everyone()).select("mode", "tau", F.round("f05", 6).alias("f05"), "n")


@query(f"select round(avg({_F05}), 6) as f05, count(*) as n from ({_JUDGED.format(by='', cross='', keys='', chosen='(select b.i, b.j from best b join truth_ using (i, j))')})", "s1", "truth_", "best")
def oracle_ceiling(spark, sf_dir):
    b = Base(spark, sf_dir)
    perfect = b.best().select("i", "j").join(b.true_pairs(), ["i", "j"], "left_semi")
    return decide.f05(perfect, b.true_pairs(), b.everyone()).select(F.round("f05", 6).alias("f05"), "n")


# Siblings ------------------------------------------------------------------------


@query("select i, anchor, p2 from anchor", "anchor")
def anchors(spark, sf_dir):
    return expand.anchors(Base(spark, sf_dir).scored())


@query("select distinct a.i, n.n as j, a.anchor from anchor a join near n on n.a = a.anchor anti join scored s on s.i = a.i and s.j = n.n", "anchor", "near", "scored")
def sibling_hop(spark, sf_dir):
    b = Base(spark, sf_dir)
    scored = b.scored()
    return expand.sibling_hop(expand.anchors(scored), blocking.neighbours(b.right), scored)


@query("""select s.i, s.j, coalesce(sib_nm, -1.0) as sib_nm, coalesce(sib_ad, -1.0) as sib_ad, greatest(coalesce(sib_nm, -1.0), coalesce(sib_ad, -1.0)) as sib_best, coalesce(n90, 0)::double as sib_n90, coalesce(n_anchor, 0)::double as n_anchor
    from scored s left join (select i, j, max(nm) as sib_nm, max(ad) as sib_ad, count(*) filter (greatest(nm, ad) >= 90) as n90 from (
        select s.i, s.j, round(100 * {nm}, 6) as nm, round(100 * {ad}, 6) as ad from scored s join anchor a using (i) join prep x on x.entity_id = s.j join prep y on y.entity_id = a.anchor where s.j <> a.anchor) group by i, j) using (i, j)
    left join (select i, count(*) as n_anchor from anchor group by i) using (i)""".format(nm=O.jaccard(O.words("replace(x.name_vars, '|', ' ')"), O.words("replace(y.name_vars, '|', ' ')")), ad=O.jaccard(O.words("x.addr_n"), O.words("y.addr_n"))), "scored", "anchor", "prep")
def sibling_features(spark, sf_dir):
    """The features over word overlap, which SQL can repeat, in place of the token-set score."""
    b = Base(spark, sf_dir)
    scored = b.scored()
    anchor = expand.anchors(scored)
    one = b.right.select(F.col("entity_id").alias("j"), F.translate("name_vars", "|", " ").alias("nj"), F.col("addr_n").alias("aj"))
    two = one.toDF("anchor", "na", "aa")
    like = lambda x, y: F.round(100 * S.jaccard(blocking.words(F.col(x)), blocking.words(F.col(y))), 6)
    met = expand.anchor_pairs(scored, anchor).join(one, "j").join(two, "anchor").select("i", "j", "anchor", like("nj", "na").alias("_sn"), like("aj", "aa").alias("_sa"))
    return expand.sibling_features(scored, anchor, met).select("i", "j", "sib_nm", "sib_ad", "sib_best", "sib_n90", "n_anchor")


@query()
def like_siblings(spark, sf_dir):
    b = Base(spark, sf_dir)
    scored = b.scored()
    hops = expand.sibling_hop(expand.anchors(scored), blocking.neighbours(b.right), scored)
    return expand.like_siblings(hops, b.right)


# Decision ------------------------------------------------------------------------


@query("select i, j, p from excl", "excl")
def exclusive(spark, sf_dir):
    return Base(spark, sf_dir).exclusive()


@query("select i, j, p from excl where p > 0 and p >= 0.4", "excl")
def select_thr(spark, sf_dir):
    return decide.select_threshold(Base(spark, sf_dir).exclusive(), 0.4)


@query("select i, j, p from chosen where tau = 0.4", "chosen")
def select_exp(spark, sf_dir):
    return decide.select_expected(Base(spark, sf_dir).exclusive(), 0.4).select("i", "j", "p")


@query(f"select round(avg({_F05}), 6) as f05, count(*) as n from ({_JUDGED.format(by='', cross='', keys='', chosen='(select i, j from chosen where tau = 0.4)')})", "s1", "truth_", "chosen")
def macro_f05(spark, sf_dir):
    b = Base(spark, sf_dir)
    chosen = decide.select_expected(b.exclusive(), 0.4).select("i", "j")
    return decide.f05(chosen, b.true_pairs(), b.everyone()).select(F.round("f05", 6).alias("f05"), "n")


# Validation ----------------------------------------------------------------------


@faulty("select id, count(*) as n from rows_ group by id having count(*) > 1")
def val_dup_rows(spark, sf_dir):
    return validate.dup_rows(Base(spark, sf_dir).lists())


@faulty("select id, len(ids) - len(list_distinct(ids)) as n from rows_ where len(ids) <> len(list_distinct(ids))")
def val_dup_ids(spark, sf_dir):
    return validate.dup_ids(Base(spark, sf_dir).lists())


@faulty("select id, entry, case when starts_with(entry, 'S1-') then 'source1' else 'other' end as kind from entries where not starts_with(entry, 'S2-') and not starts_with(entry, 'S3-')")
def val_prefix(spark, sf_dir):
    return validate.wrong_prefix(Base(spark, sf_dir).lists())


@faulty("select distinct entry from entries where (starts_with(entry, 'S2-') or starts_with(entry, 'S3-')) and entry not in (select entity_id from biz)")
def val_unknown(spark, sf_dir):
    b = Base(spark, sf_dir)
    return validate.unknown(b.lists(), b.raw)


@faulty("select i as id from s1 where i not in (select id from rows_)")
def val_missing(spark, sf_dir):
    b = Base(spark, sf_dir)
    return validate.missing(b.lists(), b.left)


@faulty("select distinct id from rows_ where id not in (select i from s1)")
def val_extra(spark, sf_dir):
    b = Base(spark, sf_dir)
    return validate.extra(b.lists(), b.left)


@faulty("select distinct id, entry from entries where (id, entry) not in (select i, j from best)")
def val_subset(spark, sf_dir):
    b = Base(spark, sf_dir)
    candidates = b.best().groupBy(F.col("i").alias("id")).agg(F.collect_list("j").alias("ids"))
    return validate.not_candidates(b.lists(), candidates)
