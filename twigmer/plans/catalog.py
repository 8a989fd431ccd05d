"""Registered queries over the driver tables, by name, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twigmer.functions import scoring
from twigmer.operators import alignment as al
from twigmer.operators import compare, database, kmers, posting_blocks, quantiles
from twigmer.operators import tree as tr
from twigmer.plans import derived
from twigmer.plans.derived import K, OMEGA, OMEGA_B
from twigmer.sources import ar_blocks
from twigmer.sources import text_formats as tf
from twigmer.sources.shared import new_path
from twigmer.streaming import best_scores

EPS, EPS_B = scoring.log_threshold(OMEGA, K, 4), scoring.log_threshold(OMEGA_B, K, 4)
THRESHOLD = scoring.score_threshold(OMEGA, K, 4)
#: For three of 20 states; not a value that products of the derived probabilities meet exactly.
OMEGA_AMINO = 2.03
N_NODES = 31  # of the nation tree: one root, 5 regions, 25 nations
#: Among the gap ratios of the documents' columns (0.82 to 0.84), so that some columns go and some stay.
RATIO = 0.8385

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


# ---- pieces of DuckDB SQL

PP = """cnt as (select l_suppkey as node, cast(l_partkey % 24 as int) as site, cast((l_orderkey + l_linenumber * l_linenumber) % 4 as int) as state, count(*) as c
    from lineitem group by 1, 2, 3),
pp as (select node, site, state, cast(c as double) / sum(c) over (partition by node, site) as p,
    log10(cast(c as double) / sum(c) over (partition by node, site)) as lp from cnt)"""
BEST = PP + ",\nbest as (select node, site, max(lp) as best from pp group by 1, 2)"


def enum_sql(omega: float) -> str:
    return f"""select a.node, a.site as position, cast(a.state * 64 + b.state * 16 + c.state * 4 + d.state as bigint) as code, a.lp + b.lp + c.lp + d.lp as score
    from pp a join pp b on b.node = a.node and b.site = a.site + 1 join pp c on c.node = a.node and c.site = a.site + 2
    join pp d on d.node = a.node and d.site = a.site + 3
    where a.lp + b.lp + c.lp + d.lp > 4 * log10(cast({omega} as double) / 4)"""


KM = PP + f",\nkm as ({enum_sql(OMEGA)})"
DB = KM + ",\ndb as (select cast(s_nationkey as int) as branch, code, max(score) as score from km join supplier on s_suppkey = node group by 1, 2)"
H = "(case when {0} > 0 then -({0}) * log2({0}) else 0 end)"
T = f"pow(cast({OMEGA} as double) / 4, 4)"
FV = (
    DB
    + f""",
x as (select code, branch, least(pow(10.0, score), 1.0) as x from db),
s as (select code, count(*) as n, sum(x) + ({N_NODES} - count(*)) * {T} as total from x group by 1),
fv as (select s.code, any_value(total) * (sum({H.format("x / total")}) + any_value({N_NODES} - n) * any_value({H.format(f"{T} / total")}) - log2({N_NODES})) as filter_value
    from s join x using (code) group by 1)"""
)
LETTERS = " || ".join(f"substr('ACGT', cast((code >> {2 * (3 - i)}) & 3 as int) + 1, 1)" for i in range(4))
NODES = """nodes as (
    select 'root' as label, cast(null as varchar) as parent, cast(0 as double) as bl, '' as path union all
    select 'R' || r_regionkey, 'root', cast(0.1 as double) * (r_regionkey + 1), '.' || lpad(cast(r_regionkey as varchar), 12, '0') from region union all
    select 'N' || n_nationkey, 'R' || n_regionkey, cast(0.05 as double) * (n_nationkey % 7 + 1), '.' || lpad(cast(n_regionkey as varchar), 12, '0') || '.' || lpad(cast(n_nationkey as varchar), 12, '0') from nation{0}),
t as (select *, row_number() over (order by path || '~') - 1 as postorder, row_number() over (order by path) - 1 as preorder,
    label not in (select parent from nodes where parent is not null) as leaf, (select count(*) from nodes) as total from nodes)"""
NT = NODES.format("")
ST = NODES.format(
    """ union all
    select 'S' || s_suppkey, 'N' || s_nationkey, round(abs(s_acctbal) / 10000, 4), '.' || lpad(cast(n_regionkey as varchar), 12, '0') || '.' || lpad(cast(n_nationkey as varchar), 12, '0') || '.' || lpad(cast(s_suppkey as varchar), 12, '0')
    from supplier join nation on n_nationkey = s_nationkey"""
)
STATS = """cl as (select label as anc, label as node, cast(0 as double) as dist from t
    union all select p.parent, cl.node, cl.dist + p.bl from cl join t p on p.label = cl.anc where p.parent is not null),
st as (select anc as label, count(*) filter (where t.leaf) as n_leaves, count(*) as n_nodes, coalesce(sum(t.bl) filter (where cl.anc <> cl.node), 0) as subtree_length,
    coalesce(sum(dist) filter (where t.leaf), 0) as leaf_distance from cl join t on t.label = cl.node group by 1)"""
TREE_STATS = f"with recursive {ST},\n{STATS}"
GHOSTS = (
    TREE_STATS
    + """,
gh as (select t.label, parent, postorder, total, bl / 2 as x0, bl - bl / 2 as own,
    case when leaf then bl / 2 else (leaf_distance + (bl - bl / 2) * n_leaves) / n_leaves end as x1 from t join st using (label) where parent is not null)"""
)
AL = """parts as (select doc_id, case when coalesce(text, '') = '' then [''] else regexp_extract_all(text, '(?s).{1,60}') end as p from documents),
al as (select doc_id * 4294967296 + i as seq_idx, 'D' || doc_id || '_' || i as header,
    rpad(regexp_replace(translate(part, 'acgt', 'ACGT'), '[^ACGT]', '-', 'g'), 60, '-') as seq from (select doc_id, unnest(range(len(p))) as i, unnest(p) as part from parts)),
ch as (select header, seq_idx, i - 1 as site, substr(seq, i, 1) as ch from (select *, unnest(range(1, 61)) as i from al)),
gr as (select site, avg(case when ch = '-' then 1.0 else 0.0 end) as ratio from ch group by 1)"""


# ---- shared plans


def km(spark: SparkSession, d: str, omega: float = OMEGA, engine: str = "numpy") -> DataFrame:
    return kmers.enumerate_kmers(derived.matrix(spark, d), K, 4, scoring.log_threshold(omega, K, 4), engine)


def best(spark: SparkSession, d: str, omega: float = OMEGA, positions: bool = False) -> DataFrame:
    return database.best_per_branch(km(spark, d, omega), derived.branches(spark, d), positions)


def shifted(df: DataFrame) -> DataFrame:
    """Another database to compare with: every seventh code scores a little higher."""
    return df.withColumn("score", F.col("score") + F.when(F.col("code") % 7 == 0, 0.05).otherwise(0.0))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return tr.with_orders(derived.supplier_tree(spark, d)).drop("child_ord")


def nations(spark: SparkSession, d: str) -> DataFrame:
    return tr.with_orders(derived.nation_tree(spark, d))


# ---- matrices and windows


@query(f"with {PP} select node, site, state, round(p, 6) as p, round(lp, 6) as logp from pp")
def p05_pp_matrix(spark, d):
    return derived.cells(spark, d).select("node", "site", "state", r6("p"), r6(scoring.log_probability(F.col("p")), "logp"))


@query(f"with {BEST} select node, site, round(best, 6) as best from best")
def a13_column_max(spark, d):
    return derived.matrix(spark, d).select("node", "site", r6("best"))


@query(f"with {BEST} select node, site, round(sum(best) over (partition by node order by site), 6) as prefix from best")
def w03_prefix_sum(spark, d):
    return kmers.prefix_sums(derived.matrix(spark, d)).select("node", "site", r6("prefix"))


@query(
    f"with {BEST} select a.node, a.site, round(a.best + b.best + c.best, 6) as range_best from best a join best b on b.node = a.node and b.site = a.site + 1 join best c on c.node = a.node and c.site = a.site + 2"
)
def w04_range_max(spark, d):
    return kmers.range_best(derived.matrix(spark, d), 3).select("node", "site", r6("range_best"))


@query(
    f"with {BEST} select a.node, a.site as position, 4 as width, round(a.best, 6) as first_best, round(d.best, 6) as last_best from best a join best b on b.node = a.node and b.site = a.site + 1 join best c on c.node = a.node and c.site = a.site + 2 join best d on d.node = a.node and d.site = a.site + 3"
)
def w01_windows(spark, d):
    w = kmers.windows(derived.matrix(spark, d), K)
    return w.select("node", "position", F.size("win").alias("width"), r6(F.col("win")[0]["best"], "first_best"), r6(F.col("win")[K - 1]["best"], "last_best"))


@query(
    f"""with {BEST}, w as (select a.node, a.site as position from best a join best b on b.node = a.node and b.site = a.site + 1 join best c on c.node = a.node and c.site = a.site + 2 join best d on d.node = a.node and d.site = a.site + 3)
select w.node, w.position, p.position as previous, n.position as next from w left join w p on p.node = w.node and p.position = w.position - 2 left join w n on n.node = w.node and n.position = w.position + 2"""
)
def w02_chained_windows(spark, d):
    return kmers.chained_windows(derived.matrix(spark, d), K)


@query(f"with {BEST} select node, site, state, round(best, 6) as best from (select node, site, state, lp as best, row_number() over (partition by node, site order by lp desc, state) as r from pp) where r = 1")
def a17_max_at(spark, d):
    return kmers.best_state(derived.matrix(spark, d)).select("node", "site", "state", r6("best"))


@query(
    f"""with {PP}, q as (select node, list_sort(list(p)) as v, greatest(0, least(count(*) * 0.25 - 0.5, count(*) - 1)) as h from pp group by 1)
select node, round(v[cast(floor(h) as int) + 1] + (v[least(cast(floor(h) as int) + 1, len(v) - 1) + 1] - v[cast(floor(h) as int) + 1]) * (h - floor(h)), 6) as quantile from q"""
)
def a18_hazen_quantile(spark, d):
    v = derived.cells(spark, d).groupBy("node").agg(F.sort_array(F.collect_list("p")).alias("v"))  # at most the sites times the states
    return v.select("node", r6(scoring.hazen_quantile(F.col("v"), 0.25), "quantile"))


# ---- k-mers


def _enumerated(engine: str):
    def run(spark, d):
        if engine == "numpy":
            rows = kmers.enumerate_numpy(derived.matrix(spark, d), K, 4, EPS, every=True)
        else:
            rows = km(spark, d, engine=engine)
        return rows.select("node", "position", "code", r6("score"))

    return run


for _engine in kmers.ENGINES:
    QUERIES[f"j01_enumerate_k4_{_engine}"] = _enumerated(_engine)
    ORACLE_SQL[f"j01_enumerate_k4_{_engine}"] = f"with {KM} select node, position, code, round(score, 6) as score from km"


def long_sql(k: int, omega: float = OMEGA) -> str:
    """CTEs ``km(node, position, code, score)`` at this k: halves are bounded by the best of the other before they are joined."""
    h = k // 2

    def half(name: str, n: int, begin: int, rest: str) -> str:
        sites = [f"p{i}" for i in range(n)]
        code, score = " + ".join(f"{s}.state * {4 ** (n - 1 - i)}" for i, s in enumerate(sites)), " + ".join(f"{s}.lp" for s in sites)
        joins = " ".join(f"join pp {s} on {s}.node = w.node and {s}.site = w.position + {begin + i}" for i, s in enumerate(sites))
        return f"{name} as materialized (select w.node, w.position, cast({code} as bigint) as code, {score} as s from w {joins} where {score} + w.{rest} > {k} * log10(cast({omega} as double) / 4) - 1e-9)"

    at = lambda i: f"b{i}"
    joins = " ".join(f"join best {at(i)} on {at(i)}.node = b0.node and {at(i)}.site = b0.site + {i}" for i in range(1, k))
    first, last = (" + ".join(f"{at(i)}.best" for i in r) for r in (range(h), range(h, k)))
    return f"""{BEST},
w as materialized (select b0.node, b0.site as position, {first} as first_best, {last} as last_best from best b0 {joins}),
{half("l", h, 0, "last_best")},
{half("r", k - h, h, "first_best")},
km as (select node, position, l.code * {4 ** (k - h)} + r.code as code, l.s + r.s as score from l join r using (node, position) where l.s + r.s > {k} * log10(cast({omega} as double) / 4))"""


def _long(k: int, engine: str):
    def run(spark, d):
        rows = kmers.enumerate_kmers(derived.matrix(spark, d), k, 4, scoring.log_threshold(OMEGA, k, 4), engine)
        return rows.select("node", "position", "code", r6("score"))

    return run


for _name, _k, _engine in (("j01_enumerate_k8", 8, "sorted"), ("j02_chained_k8", 8, "chained"), ("j02_chained_k5", 5, "chained")):
    QUERIES[_name] = _long(_k, _engine)
    ORACLE_SQL[_name] = f"with {long_sql(_k)} select node, position, code, round(score, 6) as score from km"


@query(
    f"""with {PP.replace("% 4 as int", "% 20 as int")}, km as (select a.node, a.site as position, cast(a.state * 400 + b.state * 20 + c.state as bigint) as code, a.lp + b.lp + c.lp as score
    from pp a join pp b on b.node = a.node and b.site = a.site + 1 join pp c on c.node = a.node and c.site = a.site + 2)
select node, position, code, substr('{scoring.AMINO}', cast(code // 400 as int) + 1, 1) || substr('{scoring.AMINO}', cast(code // 20 % 20 as int) + 1, 1) || substr('{scoring.AMINO}', cast(code % 20 as int) + 1, 1) as kmer,
    round(score, 6) as score from km where score > 3 * log10(cast({OMEGA_AMINO} as double) / 20)"""
)
def p06_amino(spark, d):
    rows = kmers.enumerate_numpy(derived.matrix(spark, d, 20), 3, 20, scoring.log_threshold(OMEGA_AMINO, 3, 20), every=True)
    return rows.select("node", "position", "code", scoring.decode(F.col("code"), 3, scoring.AMINO).alias("kmer"), r6("score"))


@query(f"with {PP}, km as ({enum_sql(OMEGA_B)}) select node, count(*) as n, round(min(score), 6) as least from km group by 1")
def p11_threshold(spark, d):
    rows = kmers.enumerate_numpy(derived.matrix(spark, d), K, 4, EPS_B, every=True)
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("least"))


@query(f"with {KM} select count(*) as tuples from km")
def a11_tuple_count(spark, d):
    return kmers.enumerate_numpy(derived.matrix(spark, d), K, 4, EPS, every=True).agg(F.count(F.lit(1)).alias("tuples"))


@query(f"with {DB} select branch, code, round(score, 6) as score from db")
def a02_branch_kmer_max(spark, d):
    return best(spark, d).select("branch", "code", r6("score"))


@query(
    f"""with {KM} select branch, code, round(round(score, 9), 6) as score, position from (select cast(s_nationkey as int) as branch, code, score, position,
    row_number() over (partition by s_nationkey, code order by round(score, 9) desc, node, position) as r from km join supplier on s_suppkey = node) where r = 1"""
)
def a03_argmax_position(spark, d):
    rows = kmers.enumerate_numpy(derived.matrix(spark, d), K, 4, EPS, every=True).withColumn("score", F.round("score", 9))
    return database.best_per_branch(rows, derived.branches(spark, d), positions=True).select("branch", "code", r6("score"), "position")


@query(f"with {DB} select code, max(round(score, 6)) as score from db group by 1")
def a19_merge_branches(spark, d):
    return database.merged_branches(best(spark, d)).select("code", r6("score"))


@query(f"with {DB} select code, count(*) as n, string_agg(branch || ':' || cast(round(score * 1000000) as bigint), ',' order by branch) as entries from db group by 1")
def a04_postings(spark, d):
    text = F.transform("entries", lambda e: F.concat_ws(":", e["branch"].cast("string"), F.round(e["score"] * 1000000).cast("long").cast("string")))
    return database.postings(best(spark, d)).select("code", F.size("entries").cast("long").alias("n"), F.array_join(text, ",").alias("entries"))


@query(f"with {DB} select count(*) as num_entries from db")
def a09_num_entries(spark, d):
    return database.counts(best(spark, d)).select("num_entries")


@query(f"with {DB} select count(distinct code) as num_kmers from db")
def a10_num_kmers(spark, d):
    return database.counts(best(spark, d)).select("num_kmers")


@query(f"with {FV} select code, n, round(total, 6) as total from s")
def a05_score_sum(spark, d):
    return database.score_sums(best(spark, d), THRESHOLD, N_NODES).select("code", "n", r6("total"))


@query(f"with {FV} select code, round(filter_value, 6) as filter_value from fv")
def a06_mif0(spark, d):
    return database.mif0(best(spark, d), THRESHOLD, N_NODES).select("code", r6("filter_value"))


@query(
    f"""with {DB}, h as (select distinct code, (code % 2147483629 * 1640531527 + 42) % 2147483629 as x from db), g as (select code, (x * x + x * 1640531527 + 42) % 2147483629 as x from h)
select code, round(cast((x * x + x * 1640531527 + 7) % 2147483629 as double) / 2147483629, 9) as filter_value from g"""
)
def a07_random(spark, d):
    return database.random_filter(best(spark, d)).select("code", F.round("filter_value", 9).alias("filter_value"))


@query(f"with {FV} select code, {LETTERS} as kmer, round(filter_value, 6) as filter_value, n as n_entries from fv join s using (code)")
def o02_sorted_db(spark, d):
    rows = database.mif0(best(spark, d), THRESHOLD, N_NODES, entries="n_entries").orderBy("filter_value", "code")
    return rows.select("code", scoring.decode(F.col("code"), K, scoring.DNA).alias("kmer"), r6("filter_value"), "n_entries")


@query(f"with {FV}, r as (select code, round(filter_value, 9) as f, row_number() over (order by round(filter_value, 9), code) as r, count(*) over () as n from fv) select code, round(f, 6) as filter_value from r where r <= ceil(0.25 * n)")
def o05_top_mu(spark, d):
    fv = database.mif0(best(spark, d), THRESHOLD, N_NODES).withColumn("filter_value", F.round("filter_value", 9))
    return database.most_informative(fv, 0.25).select("code", r6("filter_value"))


@query(f"with {DB} select cast(code % 32 as int) as batch, count(distinct code) as n_kmers, count(*) as n_entries from db group by 1")
def f08_batch(spark, d):
    b = best(spark, d).groupBy(scoring.batch_of(F.col("code")).alias("batch"))
    return b.agg(F.count_distinct("code").alias("n_kmers"), F.count(F.lit(1)).alias("n_entries"))


@query(f"with {DB} select distinct code, {LETTERS} as kmer from db")
def f07_decode(spark, d):
    return best(spark, d).select("code", scoring.decode(F.col("code"), K, scoring.DNA).alias("kmer")).distinct()


@query(f"with {DB}, {NT} select {LETTERS} as kmer, preorder as branch, round(pow(10.0, score), 6) as score from db join t on t.label = 'N' || branch")
def j08_dump(spark, d):
    t = nations(spark, d).join(table_of_branches(spark, d), "label").select(F.col("branch").alias("postorder"), "preorder")
    return compare.dump(best(spark, d), t, K, scoring.DNA).select("kmer", "branch", r6("score"))


def table_of_branches(spark: SparkSession, d: str) -> DataFrame:
    n = derived.table(spark, d, "nation")
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_nationkey").cast("int").alias("branch"))


TWO = (
    DB
    + f""",
km2 as ({enum_sql(OMEGA_B)}),
db2 as (select cast(s_nationkey as int) as branch, code, max(score) + case when code % 7 = 0 then 0.05 else 0 end as score from km2 join supplier on s_suppkey = node group by 1, 2)"""
)


@query(
    f"""with {TWO} select code, branch, round(db.score, 6) as score_a, round(db2.score, 6) as score_b,
    case when db2.score is null then 'only_a' when db.score is null then 'only_b' else 'score' end as kind
from db full join db2 using (code, branch) where db.score is null or db2.score is null or abs(db.score - db2.score) >= 0.01"""
)
def j09_db_diff(spark, d):
    rows = compare.database_diff(best(spark, d), shifted(best(spark, d, OMEGA_B)))
    return rows.select("code", "branch", r6("score_a"), r6("score_b"), "kind")


@query(
    f"""with {TWO}, m as (select code, branch, db.score as a, db2.score as b from db full join db2 using (code, branch)),
v as (select count(*) filter (where b is null) as only_a, count(*) filter (where a is null) as only_b, count(*) filter (where abs(a - b) >= 0.01) as moved, count(a) as na, count(b) as nb from m),
c as (select (select count(distinct code) from db) as ka, (select count(distinct code) from db2) as kb)
select 'k' as field, '4' as a, '4' as b, true as same union all select 'omega', '{OMEGA}', '{OMEGA_B}', false
union all select 'num_kmers', cast(ka as varchar), cast(kb as varchar), ka = kb from c union all select 'num_entries', cast(na as varchar), cast(nb as varchar), na = nb from v
union all select 'entries_of_one', cast(only_a as varchar), cast(only_b as varchar), only_a + only_b = 0 from v
union all select 'scores', cast(moved as varchar), cast(moved as varchar), moved = 0 from v"""
)
def k12_diff_report(spark, d):
    made = []
    for omega, change in ((OMEGA, lambda x: x), (OMEGA_B, shifted)):
        path, b = new_path(spark), change(best(spark, d, omega))
        header = database.counts(b).select(F.lit(K).alias("k"), F.lit(omega).alias("omega"), "num_kmers", "num_entries")
        database.write_database(path, b, database.mif0(b, THRESHOLD, N_NODES), header)
        made.append(path)
    return compare.difference_report(*(database.read_database(spark, p) for p in made))


@query(
    f"""with {TWO}, a as (select {LETTERS} as kmer, branch, pow(10.0, score) as s from db), b as (select {LETTERS} as kmer, branch, pow(10.0, score) as s from db2)
select kmer, branch, round(a.s, 6) as score_a, round(b.s, 6) as score_b from a full join b using (kmer, branch)
where kmer in (select kmer from a) and not (coalesce(abs(a.s - {T}) < 0.001, false) or coalesce(abs(b.s - {T}) < 0.001, false) or coalesce(abs(a.s - b.s) < 0.001, false))"""
)
def j10_text_diff(spark, d):
    text = lambda b: b.select(scoring.decode(F.col("code"), K, scoring.DNA).alias("kmer"), "branch", scoring.linear(F.col("score")).alias("score"))
    rows = compare.text_diff(text(best(spark, d)), text(shifted(best(spark, d, OMEGA_B))), THRESHOLD)
    return rows.select("kmer", "branch", r6("score_a"), r6("score_b"))


@query(f"with {BEST} select node, site, state, round(lp, 6) as logp from pp join supplier on s_suppkey = node where s_nationkey % 5 = 1")
def j05_pruned_matrix(spark, d):
    path = new_path(spark)
    kmers.write_matrix(path, derived.matrix(spark, d))
    wanted = derived.table(spark, d, "supplier").where("s_nationkey % 5 = 1").select(F.col("s_suppkey").alias("node"))
    rows = kmers.read_matrix(spark, path, wanted).select("node", "site", F.posexplode("logp").alias("state", "logp"))
    return rows.where(F.col("logp") > float("-inf")).select("node", "site", "state", r6("logp"))


# ---- databases at k = 8, with suppliers as branches

LONG_K = 8
LONG_T = scoring.score_threshold(OMEGA, LONG_K, 4)


def long_fv_sql() -> str:
    t, n = f"pow(cast({OMEGA} as double) / 4, {LONG_K})", "(select count(*) from supplier)"
    return f"""{long_sql(LONG_K)},
db as (select cast(node as int) as branch, code, max(score) as score from km group by 1, 2),
x as (select code, branch, least(pow(10.0, score), 1.0) as x from db),
s as (select code, count(*) as n, sum(x) + ({n} - count(*)) * {t} as total from x group by 1),
fv as (select s.code, any_value(total) * (sum({H.format("x / total")}) + any_value({n} - n) * any_value({H.format(f"{t} / total")}) - log2({n})) as filter_value
    from s join x using (code) group by 1)"""


LONG_FV = long_fv_sql()


def long_best(spark: SparkSession, d: str, omega: float = OMEGA) -> DataFrame:
    found = kmers.enumerate_kmers(derived.matrix(spark, d), LONG_K, 4, scoring.log_threshold(omega, LONG_K, 4))
    own = derived.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").cast("int").alias("branch"), F.col("s_suppkey").alias("node_order"))
    return database.best_per_branch(found, own)


@query(f"with {LONG_FV} select code, branch // 64 as block, min(branch) as first, cast(count(*) as int) as n, round(max(score), 6) as best, string_agg(branch || ':' || cast(round(score * 1000000) as bigint), ',' order by branch) as entries from db group by 1, 2")
def a04_posting_blocks_k8(spark, d):
    b = posting_blocks.posting_blocks(long_best(spark, d), 64)
    listed = F.zip_with("steps", "scores", lambda s, x: F.concat_ws(":", (F.col("first") + s).cast("string"), F.round(x * 1000000).cast("long").cast("string")))
    return b.select("code", "block", "first", "n", r6("best"), F.array_join(listed, ",").alias("entries"))


@query(f"with {LONG_FV} select code, round(filter_value, 6) as filter_value, n as n_entries from fv join s using (code)")
def o02_sorted_db_k8(spark, d):
    n = derived.table(spark, d, "supplier").count()
    rows = database.mif0(long_best(spark, d), LONG_T, n, entries="n_entries").orderBy("filter_value", "code")
    return rows.select("code", r6("filter_value"), "n_entries")


@query(f"with {LONG_FV} select code, branch, round(score, 6) as score from db where code in (select (p_size * 1311) % 65536 from part)")
def s09_lookup_k8(spark, d):
    path = new_path(spark)
    posting_blocks.write_by_code(path, long_best(spark, d))
    codes = derived.table(spark, d, "part").select(((F.col("p_size") * 1311) % 65536).cast("long").alias("code")).distinct()
    found = posting_blocks.lookup(spark, path, [r.code for r in codes.collect()])  # one for each size of a part: 50
    return posting_blocks.entries(found).select("code", "branch", r6("score"))


@query(
    f"""with {long_sql(LONG_K)}, db as (select cast(node as int) as branch, code, max(score) as score from km group by 1, 2),
db2 as (select branch, code, score + case when code % 7 = 0 then 0.05 else 0 end as score from db where score > {LONG_K} * log10(cast({OMEGA_B} as double) / 4))
select code, branch, round(db.score, 6) as score_a, round(db2.score, 6) as score_b,
    case when db2.score is null then 'only_a' when db.score is null then 'only_b' else 'score' end as kind
from db full join db2 using (code, branch) where db.score is null or db2.score is null or abs(db.score - db2.score) >= 0.01"""
)
def j09_db_diff_k8(spark, d):
    rows = compare.database_diff(long_best(spark, d), shifted(long_best(spark, d, OMEGA_B)))
    return rows.select("code", "branch", r6("score_a"), r6("score_b"), "kind")


# ---- order statistics and streams


@query(
    """with v as (select l_suppkey as supplier, l_extendedprice as x from lineitem union all select null, l_extendedprice from lineitem),
q as (select supplier, list_sort(list(cast(x as double))) as v, count(*) as n, greatest(0, least(count(*) * 0.9 - 0.5, count(*) - 1)) as h from v group by 1)
select supplier, n, round(v[cast(floor(h) as int) + 1] + (v[least(cast(floor(h) as int) + 1, len(v) - 1) + 1] - v[cast(floor(h) as int) + 1]) * (h - floor(h)), 6) as quantile from q"""
)
def a18_exact_quantiles(spark, d):
    li = derived.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_extendedprice")
    one = quantiles.hazen_quantiles(li, "l_extendedprice", 0.9, "supplier")
    every = quantiles.hazen_quantiles(li, "l_extendedprice", 0.9).select(F.lit(None).cast(li.schema["supplier"].dataType).alias("supplier"), "n", "quantile")
    return one.unionByName(every).select("supplier", "n", r6("quantile"))


@query(ORACLE_SQL["a03_argmax_position"])
def a03_streamed(spark, d):
    rows = kmers.enumerate_numpy(derived.matrix(spark, d), K, 4, EPS, every=True).withColumn("score", F.round("score", 9))
    arriving = rows.join(derived.branches(spark, d), "node").select("branch", "code", "score", F.col("node_order").cast("long").alias("node_order"), "position")
    path = new_path(spark)
    arriving.repartition(4, "node_order").write.parquet(f"{path}/kmers")  # four files: as many batches
    return best_scores.run_to_end(spark, f"{path}/kmers", f"{path}/run").select("branch", "code", r6("score"), "position")


# ---- alignments


@query(f"with {AL} select cast(site as int) as site, round(ratio, 6) as ratio from gr")
def a01_gap_ratio(spark, d):
    return al.gap_ratios(derived.alignment(spark, d)).select("site", r6("ratio"))


@query(f"with {AL} select header, string_agg(ch, '' order by site) as seq from ch where site in (select site from gr where ratio < {RATIO}) group by 1")
def p01_reduce(spark, d):
    return al.drop_gap_columns(derived.alignment(spark, d), RATIO).select("header", "seq")


@query(
    """with parts as (select doc_id, case when coalesce(text, '') = '' then [''] else regexp_extract_all(text, '(?s).{1,60}') end as p from documents)
select 'D' || doc_id || '_' || i as header from (select doc_id, unnest(range(len(p))) as i, unnest(p) as part from parts) where regexp_matches(upper(part), '(?s)[^ACGT-]')"""
)
def p04_unsupported_states(spark, d):
    return al.unsupported_states(derived.document_rows(spark, d), scoring.DNA).select("header")


@query(f"with {AL} select header, seq from al")
def k03_alignment_file(spark, d):
    path = new_path(spark)
    al.write_alignment(derived.alignment(spark, d), path)
    return tf.read_fasta(spark, path).select("header", "seq")


@query(f"with {AL} select 60 as width, count(*) as n_rows, count(*) filter (where length(seq) <> 60) as n_bad from al")
def p03_length_check(spark, d):
    a = derived.alignment(spark, d)
    bad = al.bad_lengths(a).agg(F.count(F.lit(1)).alias("n_bad"))
    return a.agg(F.min_by(F.length("seq"), "seq_idx").alias("width"), F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(bad))


@query(f"with {AL} select header, seq from al union all select 'D' || (s_suppkey * 7) || '_1', repeat('-', 60) from supplier where 'D' || (s_suppkey * 7) || '_1' not in (select header from al)")
def j07_extend_alignment(spark, d):
    leaves = derived.table(spark, d, "supplier").select(F.concat(F.lit("D"), (F.col("s_suppkey") * 7).cast("string"), F.lit("_1")).alias("label"))
    return al.extend_alignment(derived.alignment(spark, d), leaves)


@query(f"with {AL} select rpad(header, 250, ' ') || substr(seq, 1, 10) || ' ' || substr(seq, 11, 10) || ' ' || substr(seq, 21, 10) || ' ' || substr(seq, 31, 10) || ' ' || substr(seq, 41, 10) || ' ' || substr(seq, 51, 10) as value from al")
def k02_phylip_lines(spark, d):
    return al.phylip_lines(derived.alignment(spark, d)).select("value")


@query(f"with {AL} select header, seq from al")
def s01_fasta(spark, d):
    path = new_path(spark)
    al.fasta_lines(derived.alignment(spark, d)).write.text(path)
    return tf.read_fasta(spark, path).select("header", "seq")


# ---- trees


@query(f"with {ST} select label, postorder, preorder from t")
def t01_postorder(spark, d):
    return tree(spark, d).select("label", "postorder", "preorder")


@query(f"{TREE_STATS} select label, n_leaves, n_nodes, round(subtree_length, 6) as subtree_length from st")
def a14_subtree_stats(spark, d):
    return tr.subtree_stats(derived.supplier_tree(spark, d)).select("label", "n_leaves", "n_nodes", r6("subtree_length"))


@query(f"{TREE_STATS} select label, round(leaf_distance, 6) as leaf_distance from st")
def a15_total_branch_length(spark, d):
    return tr.subtree_stats(derived.supplier_tree(spark, d)).select("label", r6("leaf_distance"))


@query(f"with {ST} select count(*) as n_leaves from t where leaf")
def a16_count_leaves(spark, d):
    return tr.is_leaf(derived.supplier_tree(spark, d)).where("is_leaf").agg(F.count(F.lit(1)).alias("n_leaves"))


@query(f"{GHOSTS} select label, round(x0, 6) as x0_length, round(x1, 6) as x1_length from gh")
def t03_ghost_lengths(spark, d):
    return tr.ghost_lengths(tree(spark, d)).select("label", r6("x0_length"), r6("x1_length"))


@query(
    f"""{GHOSTS}, n as (select *, (total + 1 + 4 * postorder) || '_X0' as g0, (total + 2 + 4 * postorder) || '_X1' as g1, (total + 3 + 4 * postorder) || '_X2' as g2, (total + 4 + 4 * postorder) || '_X3' as g3 from gh)
select g0 as label, parent, round(x0, 6) as branch_length from n union all select g1, g0, round(x1, 6) from n union all select label, g0, round(own, 6) from n
union all select g2, g1, 0.01 from n union all select g3, g1, 0.01 from n union all select 'root', null, 0"""
)
def t02_extend_tree(spark, d):
    return tr.extend(tree(spark, d)).select("label", "parent", r6("branch_length"))


GM = f"with {ST}, gm as (select (total + 1 + 4 * postorder) || '_X0' as label, postorder as original from t where parent is not null union all select (total + 2 + 4 * postorder) || '_X1', postorder from t where parent is not null)"


@query(f"{GM} select label, original from gm")
def t04_ghost_mapping(spark, d):
    return tr.ghost_mapping(tree(spark, d))


def _ghosts(strategy: str):
    def run(spark, d):
        return tr.ghost_mapping(tree(spark, d)).where(tr.is_ghost(F.col("label"), strategy)).select("label")

    return run


for _name, _strategy, _test in (("inner", "inner-only", "label like '%\\_X0' escape '\\'"), ("outer", "outer-only", "label like '%\\_X1' escape '\\'"), ("both", "both", "true")):
    QUERIES[f"p07_ghost_{_name}"] = _ghosts(_strategy)
    ORACLE_SQL[f"p07_ghost_{_name}"] = f"{GM} select label from gm where {_test}"


@query(f"{GM} select original, string_agg(label, ',' order by label) as ghosts from gm group by 1")
def a12_ghost_groups(spark, d):
    return tr.ghost_groups(tr.ghost_mapping(tree(spark, d))).select("original", F.array_join("ghosts", ",").alias("ghosts"))


@query(f"{GM} select gm.label, t.label as node, parent from gm join t on t.postorder = gm.original")
def j03_ghost_to_original(spark, d):
    t = tree(spark, d)
    return tr.ghost_mapping(t).join(t.select(F.col("postorder").alias("original"), F.col("label").alias("node"), "parent"), "original").select("label", "node", "parent")


@query(f"with {ST} select label as ext_label, 'A' || postorder as ar_label from t")
def j06_postorder_zip(spark, d):
    t = tree(spark, d)
    return tr.map_nodes(t, t.select(F.concat(F.lit("A"), F.col("postorder").cast("string")).alias("label"), "postorder"))


@query(f"with {ST} select 'E' || postorder as ext_label, 'A' || postorder as ar_label from t where postorder % 5 <> 0 and postorder % 7 <> 0")
def p12_nonempty_labels(spark, d):
    t = tree(spark, d).select("postorder")
    named = lambda letter, n: t.select(F.when(F.col("postorder") % n != 0, F.concat(F.lit(letter), F.col("postorder").cast("string"))).otherwise("").alias("label"), "postorder")
    return tr.map_nodes(named("E", 5), named("A", 7))


@query(
    f"""with recursive {ST}, a as (select label as anc, label as node from t union all select p.parent, a.node from a join t p on p.label = a.anc where p.parent is not null),
dp as (select node as label, count(*) - 1 as depth from a group by 1), u as (select t.*, depth, p.preorder as above from t join dp using (label) left join t p on p.label = t.parent),
pieces as (select 2 * preorder - depth as place, (case when preorder > above + 1 then ',' else '' end) || (case when leaf then '' else '(' end) as piece from u union all
    select 2 * postorder + depth + 1, (case when leaf then '' else ')' end) || (case when parent is null then ';' else '' end) from u)
select place // 4096 as block, string_agg(piece, '' order by place) as shape from pieces group by 1"""
)
def k06_newick_shape(spark, d):
    blocks = tr.newick_blocks(tr.with_orders(derived.supplier_tree(spark, d), depth=True))
    return blocks.select("block", F.regexp_replace("text", "[A-Za-z0-9_]+:[0-9.E-]+|root", "").alias("shape"))


@query(
    f"""with recursive {ST} select label, case when parent is null or label = 'R0' then 'added_root' else parent end as parent, round(bl, 6) as branch_length from t
union all select 'added_root', null, 0"""
)
def t05_reroot(spark, d):
    return tr.reroot(derived.supplier_tree(spark, d)).select("label", "parent", r6("branch_length"))


@query(f"{TREE_STATS} select postorder, n_nodes as num_nodes, round(subtree_length, 6) as subtree_length from t join st using (label)")
def t07_tree_index(spark, d):
    return tr.tree_index(tree(spark, d)).select("postorder", "num_nodes", r6("subtree_length"))


# ---- sources, by a round trip through files


@query(
    """select cast(s_nationkey as varchar) as tree_id, 'S' || s_suppkey as label, round(abs(s_acctbal) / 10000, 4) as branch_length,
    row_number() over (partition by s_nationkey order by s_suppkey) - 1 as postorder, true as is_leaf from supplier
union all select cast(s_nationkey as varchar), 'N' || s_nationkey, 0, count(*), false from supplier group by s_nationkey"""
)
def s02_newick(spark, d):
    s = derived.table(spark, d, "supplier")  # a tree for each nation
    part = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(":"), F.round(F.abs("s_acctbal") / 10000, 4).cast("string"))
    lists = s.groupBy(F.col("s_nationkey").alias("tree_id")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", part.alias("part")))).alias("l"))
    inner = F.array_join(F.transform("l", lambda x: x["part"]), ",")
    trees = lists.select("tree_id", F.concat(F.lit("("), inner, F.lit(")N"), F.col("tree_id").cast("string"), F.lit(";")).alias("newick"))
    return tf.read_newick(trees).select("tree_id", "label", r6("branch_length"), "postorder", "is_leaf")


def written_probabilities(spark: SparkSession, d: str) -> str:
    """The path of the matrix as a reconstruction's table, a node's lines together."""
    path = new_path(spark)
    wide = derived.cells(spark, d).groupBy("node", "site").pivot("state", [0, 1, 2, 3]).agg(F.first("p"))
    rows = wide.select(F.col("node").alias("Node"), F.col("site").alias("Site"), F.lit("-").alias("State"), *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"p_{c}") for i, c in enumerate(scoring.DNA)])
    rows.repartitionByRange("Node").sortWithinPartitions("Node", "Site").write.csv(path, sep="\t", header=True)
    return path


def by_state(matrix: DataFrame) -> DataFrame:
    back = matrix.select(F.col("node").cast("long").alias("node"), "site", F.posexplode("logp").alias("state", "logp"))
    return back.where(F.col("logp") > float("-inf")).select("node", "site", "state", r6("logp"))


@query(f"with {PP} select node, site, state, round(lp, 6) as logp from pp")
def s03_ar_probs(spark, d):
    return by_state(tf.read_ar_table(spark, written_probabilities(spark, d)))


@query(f"with {PP} select node, site, state, round(lp, 6) as logp from pp where node in (select min(s_suppkey) from supplier union all select max(s_suppkey) from supplier)")
def s03_ar_blocks(spark, d):
    ends = derived.table(spark, d, "supplier").agg(F.min("s_suppkey").cast("string"), F.max("s_suppkey").cast("string")).first()
    return by_state(ar_blocks.read_blocks(spark, written_probabilities(spark, d)).where(F.col("node").isin(*ends)))


@query(f"with {PP} select node, site, state, round(lp, 6) as logp from pp")
def s03_ar_all_blocks(spark, d):
    return by_state(ar_blocks.read_blocks(spark, written_probabilities(spark, d)))


@query(f"with {PP.replace('% 4 as int', '% 20 as int')} select node, site, state, round(lp, 6) as logp from pp")
def p06_permuted_states(spark, d):
    path, order = new_path(spark), scoring.AMINO_FILE_ORDER
    wide = derived.cells(spark, d, 20).groupBy("node", "site").pivot("state", list(range(20))).agg(F.first("p"))
    columns = [F.coalesce(F.col(str(scoring.AMINO.index(c))), F.lit(0.0)).alias(f"p_{c}") for c in order]  # files have an order of their own
    wide.select(F.col("node").alias("Node"), F.col("site").alias("Site"), F.lit("-").alias("State"), *columns).write.csv(path, sep="\t", header=True)
    return by_state(tf.read_ar_table(spark, path, "amino"))


@query(f"with {PP} select node, site, state, round(lp, 6) as logp from pp")
def s05_phyml(spark, d):
    wide = derived.cells(spark, d).groupBy("node", "site").pivot("state", [0, 1, 2, 3]).agg(F.first("p"))
    numbers = [F.coalesce(F.col(str(i)), F.lit(0.0)).cast("string") for i in range(4)]
    lines = wide.select(F.lit(1).alias("head"), F.concat_ws("  ", F.lit(""), F.col("site").cast("string"), F.col("node").cast("string"), *numbers, F.lit("A")).alias("value"))
    title = spark.createDataFrame([(0, "Ancestral sequences\nof 1 2 3 4 5 6\n\nSite  NodeLabel  A  C  G  T  MPEE")], "head int, value string")
    path = new_path(spark)
    title.unionByName(lines).repartitionByRange(1, "head").sortWithinPartitions("head").select("value").write.text(path)  # a file has its title first
    return by_state(tf.read_phyml(spark, path))


@query(f"with {DB} select {LETTERS} as kmer, branch, round(pow(10.0, score), 6) as score from db")
def s12_plain_text(spark, d):
    path = new_path(spark)
    text = best(spark, d).select(scoring.decode(F.col("code"), K, scoring.DNA).alias("kmer"), "branch", scoring.linear(F.col("score")).alias("score"))
    compare.dump_text(text).write.text(path)
    return tf.read_dump(spark, path).select("kmer", "branch", r6("score"))


@query(
    f"""with {FV} select code, branch, round(score, 6) as score, round(filter_value, 6) as filter_value,
    (select count(distinct code) from db) as num_kmers, (select count(*) from db) as num_entries from db join fv using (code)"""
)
def s09_db_roundtrip(spark, d):
    path = new_path(spark)
    b = best(spark, d)
    database.write_database(path, b, database.mif0(b, THRESHOLD, N_NODES), database.counts(b))
    rows, header = database.read_database(spark, path)
    h = header.first()
    return database.flat(rows).select("code", "branch", r6("score"), r6("filter_value"), F.lit(h.num_kmers).alias("num_kmers"), F.lit(h.num_entries).alias("num_entries"))
