"""DuckDB SQL for the registered queries, written against the driver tables."""

from __future__ import annotations

from .queries import ALPHA, HOPS, ITERATIONS, K

EDGES = """edges as materialized (select distinct src, dst from (
  select l_partkey as src, l_quantity as q, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as dst
  from lineitem) t where dst is not null and q > 45),
nodes as materialized (select p_partkey as node from part)"""
MAT = f"{EDGES},\nmat as materialized (select src, dst, 1.0::double / count(*) over (partition by src) as p from edges),\nsize as materialized (select count(*)::double as n from nodes)"


def draw(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::bigint"


def ranks(iterations: int, where: str = "true") -> str:
    """CTEs r0 .. rN."""
    out = [MAT, "r0 as (select node, 1.0::double / n as rank from nodes, size)"]
    for i in range(1, iterations + 1):
        out.append(f"""s{i} as (select dst as node, sum(p * rank) as s from mat join r{i - 1} on src = node where {where} group by dst),
r{i} as materialized (select node, {1 - ALPHA}::double * coalesce(s, 0) + {ALPHA}::double / n as rank from nodes left join s{i} using (node), size)""")
    return "with " + ",\n".join(out)


def fm(k: int) -> str:
    """CTE h0: initial masks."""
    masks = ", ".join(f"(1::bigint << (31 - least(30, (32 - length(regexp_replace(lpad(bin({draw(f"(node::varchar || '-{i}')")}), 32, '0'), '^0+', '')))))::int) as b{i}" for i in range(k))
    return f"h0 as materialized (select node, 'i' as status, {masks} from nodes)"


def hops(k: int, n: int) -> str:
    """CTEs h0 .. hN of masks and statuses."""
    cols = ", ".join(f"b{i}" for i in range(k))
    out = [EDGES, fm(k)]
    for h in range(1, n + 1):
        ors = ", ".join(f"bit_or(b{i}) as b{i}" for i in range(k))
        differ = " or ".join(f"g.b{i} <> o.b{i}" for i in range(k))
        out.append(f"""g{h} as (select node, {ors} from (select src as node, {cols} from edges join h{h - 1} on dst = node union all select node, {cols} from h{h - 1}) t group by node),
h{h} as materialized (select g.node, case when {differ} then 'i' when o.status = 'i' then 'c' else 'f' end as status, {", ".join(f"g.b{i}" for i in range(k))} from g{h} g join h{h - 1} o on g.node = o.node)""")
    return "with " + ",\n".join(out)


def zero(m: str) -> str:
    return f"(32 - length(regexp_replace(lpad(bin({m}), 32, '0'), '^1+', '')))"


def estimate(k: int) -> str:
    return f"(pow(2.0::double, ({' + '.join(zero(f'b{i}') for i in range(k))}) / {float(k)}::double) / 0.77351::double)"


CURVE = hops(K, HOPS) + ",\ncurve as (select 0 as hop, count(*)::double as nh, 0::bigint as converged, 0::bigint as changed from nodes union all " + " union all ".join(f"select {h} as hop, sum({estimate(K)}) as nh, sum((status = 'c')::int)::bigint as converged, sum((status = 'i')::int)::bigint as changed from h{h}" for h in range(1, HOPS + 1)) + ")"
RADIUS = (
    hops(K, HOPS)
    + ",\nhistory as (select node, 0 as hop, 1.0::double as nh from nodes union all "
    + " union all ".join(f"select a.node, {h} as hop, {estimate(K)} as nh from (select node from h{h} where status = 'i') a join h{h - 1} b on a.node = b.node" for h in range(1, HOPS + 1))
    + """),
rows as (select node, hop, nh, last_value(nh) over w as top, last_value(hop) over w as last, lead(nh) over (partition by node order by hop) as next from history
  window w as (partition by node order by hop rows between unbounded preceding and unbounded following)),
radius as (select node, max(last)::int as max_radius, round(coalesce(arg_max(case when next > nh then hop + (top * 0.9::double - nh) / (next - nh) end, hop) filter (where nh < top * 0.9::double), min(hop)::double), 2) as eff_radius from rows group by node)"""
)


def walk(k: int) -> str:
    """CTE walk (hop, node, status, masks): hops until nothing changes."""
    cols, ors = ", ".join(f"b{i}" for i in range(k)), ", ".join(f"bit_or(b{i}) as b{i}" for i in range(k))
    differ = " or ".join(f"g.b{i} <> o.b{i}" for i in range(k))
    return f"""with recursive {EDGES},
{fm(k)},
walk as (select 0 as hop, node, status, {cols} from h0 union all
  select g.hop + 1, g.node, case when {differ} then 'i' when o.status = 'i' then 'c' else 'f' end, {", ".join(f"g.b{i}" for i in range(k))}
  from (select hop, node, {ors} from (select hop, src as node, {cols} from edges join walk on dst = node union all select hop, node, {cols} from walk) t group by hop, node) g
  join walk o on g.node = o.node where exists (select 1 from walk where status = 'i'))"""


WALK_CURVE = walk(K) + f""",
curve as (select hop, case when hop = 0 then count(*)::double else sum({estimate(K)}) end as nh, sum((hop > 0 and status = 'c')::int)::bigint as converged, sum((hop > 0 and status = 'i')::int)::bigint as changed from walk group by hop)"""
WALK_RADIUS = (
    walk(K)
    + f""",
history as (select node, 0 as hop, 1.0::double as nh from nodes union all
  select a.node, a.hop, {estimate(K)} as nh from (select node, hop from walk where hop > 0 and status = 'i') a join (select node, hop + 1 as hop, {", ".join(f"b{i}" for i in range(K))} from walk) b on a.node = b.node and a.hop = b.hop),
rows as"""
    + RADIUS.partition("),\nrows as")[2]
)


ENTRIES = "e as materialized (select p_partkey % 200 as id, count(*) as size from part group by 1)"


def entries(assign: str) -> str:
    return f"with {ENTRIES}, v as materialized (select id, size, {assign} as grp from e)"


PAIR_COUNT = " select a.id as l_id, count(*) as n, sum(b.id)::bigint as sum_r, sum(a.size * b.size)::bigint as work from v a join v b on {on} group by a.id"
PARTNERS = f"""with {ENTRIES}, v as (select id from e),
pair as (select a.id as l, b.id as r from v a join v b on a.id <= b.id and {draw("'p-' || a.id || '-' || b.id")} < {int(0.2 * 2**32)}),
partners as (select l as seg, r as partner from pair union select r, l from pair)"""
SEGS = "with s as (select o_orderkey as id, (o_custkey % 20)::varchar as path, o_orderkey * 37 % 5000 as off, 1 + o_orderkey * 13 % 97 as len from orders)"
COVER = """with t as (select o_orderkey as id, (o_custkey % 20)::varchar as path, o_orderkey * 7919 % 1000000 as off, (1 + o_orderkey * 13 % 97) * 5 as len from orders),
r as (select (l_partkey % 20)::varchar as path, (l_orderkey * 104729 + l_linenumber * 1299709 + l_suppkey * 31) % 1000000 as off, 1 + l_partkey * 17 % 97 as len from lineitem),
c as (select t.id, greatest(r.off, t.off) as b, least(r.off + r.len, t.off + t.len) as e from t join r on t.path = r.path and r.off < t.off + t.len and r.off + r.len > t.off),
w as (select id, b, e, max(e) over (partition by id order by b, e rows between unbounded preceding and 1 preceding) as done from c),
u as (select id, sum(greatest(0, e - greatest(b, coalesce(done, b)))) as covered from w group by id),
cover as (select t.id, path, off, len, (len - coalesce(covered, 0))::bigint as remaining from t left join u on t.id = u.id)"""
MATMUL = """select (a.vec_id // 250)::int as i, (b.vec_id // 250)::int as j, a.vec_id as r, b.vec_id as c, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as v
from embeddings a, embeddings b"""
COO = MAT + ",\ncoo as (select dst as row, src as col, p as val from mat)"


def blocks(brow: str, bcol: str, r: str, c: str) -> str:
    return f"with {COO} select ({brow})::int as brow, ({bcol})::int as bcol, count(*) as n, sum({r})::bigint as sum_r, sum({c})::bigint as sum_c from coo group by 1, 2"


NATION_PAIRS = "p as (select a.n_nationkey as l, b.n_nationkey as r from nation a join nation b on a.n_nationkey <= b.n_nationkey)"
HOSTS = f"hosts as (select distinct n_nationkey as item, {draw("'h-' || n_nationkey || '-' || k")} % 3 as host from nation, range(2) t(k))"
SCHEDULES = f"""drawn as (select l, r, {draw("'w-' || l || '-' || r")} % 3 as worker from p),
votes as (select l, r, host, count(*) as n from (select l, r, l as item from p union all select l, r, r from p) t join hosts using (item) group by l, r, host),
best as (select l, r, arg_min(host, (-n, host)) as worker from votes group by l, r)"""
LRU = """trace as (select worker, pos - 1 as step, 'l' || l as item from task union all select worker, pos, 'r' || r from task),
seen as (select worker, step, item, lag(step) over (partition by worker, item order by step) as prev from trace),
depth as (select s.worker, s.step, (select count(distinct t.item) from trace t where t.worker = s.worker and t.step > s.prev and t.step < s.step) as between_n from seen s where s.prev is not null)
select r.worker, coalesce(h.hits, 0)::bigint as hits, r.reads from (select worker, count(*) as reads from trace group by worker) r
left join (select worker, count(*) as hits from depth where between_n < 8 group by worker) h on r.worker = h.worker"""


def packs(side: int) -> str:
    return f"""q as (select l, r, l // {side} as pr, r // {side} as pc from p),
k as (select pr, pc, row_number() over (order by pr, pc) - 1 as k from (select distinct pr, pc from q) t)"""


def lru(side: int) -> str:
    return f"with {NATION_PAIRS}, {packs(side)}, task as (select k % 3 as worker, row_number() over (partition by k % 3 order by k, l, r) * 2 as pos, l, r from q join k using (pr, pc)), {LRU}"


def scheduled(by: str) -> str:
    return f"with {NATION_PAIRS}, {HOSTS}, {SCHEDULES}, task as (select worker, row_number() over (partition by worker order by l, r) * 2 as pos, l, r from {by}), {LRU}"


def indexed(tail: str) -> str:
    return f"""select c_nationkey::varchar as index, count(*) as n, sum(strlen(c_name || {tail}))::bigint as bytes, sum({draw(f"c_name || {tail}")})::bigint as digests from customer group by 1"""


R = ranks(ITERATIONS)
FINAL = f"select node, round(rank, 10) as rank from r{ITERATIONS}"

ORACLES: dict[str, str] = {
    "edges": f"with {EDGES} select src, dst from edges",
    "edge_text_scan": "select l_orderkey as src, count(*) as n, sum(l_partkey)::bigint as sum_dst from lineitem where l_linenumber not in (1, 2) group by l_orderkey",
    "vector_text_scan": "select p_partkey as node, p_retailprice as rank from part",
    "block_text_roundtrip": "select p_partkey as node, p_retailprice as v from part",
    "matrix_text_parse": "select (l_suppkey % 16)::int as row, (l_partkey % 16)::int as col, sum(l_quantity) as val from lineitem group by 1, 2",
    "block_edge_scan": f"with {COO} select (row // 64)::int as brow, (col // 64)::int as bcol, count(*) as n, sum(row % 64)::bigint as rows, sum(col % 64)::bigint as cols, round(sum(val), 9) as total from coo group by 1, 2",
    "state_text_scan": hops(2, 2) + """, past as (select node, 1 + sum(moved) as hops from (select node, 0 as moved from nodes union all select node, (status = 'i')::int from h1 union all select node, (status = 'i')::int from h2) t group by node)
select 'state' as kind, status, count(*) as n, sum(node)::bigint as nodes, 0::bigint as others, sum(b0 + b1)::bigint as masks, sum(hops)::bigint as hops from h2 join past using (node) group by status
union all select 'command', '', count(*), sum(node)::bigint, 0, 0, 0 from nodes
union all select 'edge', '', count(*), sum(dst)::bigint, sum(src)::bigint, 0, 0 from edges""",
    "state_block_scan": f"with {EDGES}, {fm(1)} select 's' as role, node, b0 as mask from h0",
    "grid_partition": f"""with {COO}, b as (select (row % 8)::int as brow, (col % 8)::int as bcol, col from coo)
select 'rows' as way, brow, bcol, ((brow * 8 + bcol) % 12)::int as part, count(*) as n from b group by 1, 2, 3, 4
union all select 'columns', brow, bcol, ((bcol * 8 + brow) % 12)::int, count(*) from b group by 1, 2, 3, 4
union all select 'column', brow, bcol, (col % 12)::int, count(*) from b group by 1, 2, 3, 4""",
    "sparse_matrix_gen": f"""with c as (select r as row, k as col from range(200) a(r), range(100) b(k) where {draw("'m-' || r || '-' || k")} < {int(0.02 * 2**32)})
select row, col from c union all select r, {draw("'mr-' || r")} % 100 from range(200) a(r) where r not in (select row from c)""",
    "expand_adjacency": f"with {MAT} select src + n::bigint as src, dst + 2 * n::bigint as dst from edges, size",
    "counter_text": "select lpad((i * 16)::varchar, 15, '0') as line from range(5000) t(i)",
    "dense_matrix_gen": """select 'A' as side, i // 10 as blk, i % 10 as r, 10 as cols, round((i // 10)::double, 6) as total from range(30) t(i)
union all select 'B', i // 10, i % 10, 10, round((i // 10)::double, 6) from range(40) t(i)""",
    "initial_ranks": f"with {MAT} select node, 1.0::double / n as rank from nodes, size",
    "initial_rank_blocks": """with p as (select p_partkey as node, p_partkey // 16 as a, p_partkey % 7 as b from part), whole as (select count(*) as n, sum(node)::bigint as ids, 1.0::double as total from p)
select 'range' as form, n, ids, total, 0::bigint as largest from whole union all select 'mod', n, ids, total, 0 from whole
union all select 'range blocks', count(*), sum(a)::bigint, 0, max(n) from (select a, count(*) as n from p group by a) t
union all select 'mod blocks', count(*), sum(b)::bigint, 0, max(n) from (select b, count(*) as n from p group by b) t""",
    "random_byte_series": f"select i as pos, ({draw("'b-' || i")} % 256 - 128)::int as val from range(4096) t(i)",
    "split_generator": f"""with s as (select i, 128 - 12 + 2 * ({draw("'s-' || i")} % 12) as size from range(80) t(i)),
o as (select i, size, coalesce(sum(size) over (order by i rows between unbounded preceding and 1 preceding), 0) as off from s)
select '/data/input0' as path, off::bigint as off, (case when i = 79 then 10240 else least(off + size, 10240) end - off)::bigint as len from o where off < 10240""",
    "indexed_text_roundtrip": indexed("chr(10)"),
    "indexed_bytes_roundtrip": indexed("''"),
    "indexed_source": indexed("chr(10)"),
    "indexed_sink": f"select * from ({indexed("''")}) t where index in ('3', '7', '11')",
    "index_file_scan": "select 'nation' || c_nationkey as index, count(*) as n, sum(c_custkey * 10)::bigint as offs, sum(strlen(c_name))::bigint as bytes from customer group by 1",
    "file_name_index": "select 4::bigint as files, 0::bigint as offs, sum(strlen(c_name) + 1)::bigint as bytes from customer",
    "pair_plan": """with e as (select c_nationkey as k, c_nationkey::varchar as index, sum(strlen(c_name) + 1)::bigint as bytes, count(*) as n from customer group by 1, 2)
select a.index as l_index, b.index as r_index, a.bytes as l_bytes, b.bytes as r_bytes, a.n + b.n as segments from e a join e b on a.index <= b.index and a.k % 5 = b.k % 5""",
    "pair_index_strings": "select 'edge' || chr(9) || n_nationkey || chr(9) || n_regionkey as l_index, 'node' || chr(9) || n_regionkey as r_index from nation union all select 'edge' || chr(9) || 'x' || chr(9) || n_regionkey, 'node' || chr(9) || n_regionkey from nation where false",
    "bandwidth_files": "select count(*) as segments, sum(strlen(c_name) + 1)::bigint as bytes, true as timed, true as rated from customer",
    "bandwidth_pairs": "select distinct c_nationkey::varchar as index, true as read, true as timed from customer where c_nationkey in (0, 5)",
    "plain_text_export": "select p_partkey as node, p_retailprice as v from part",
    "binary_pairs_roundtrip": f"""with {COO} select 'vector' as kind, (p_partkey // 64)::int as b, count(*) as n, round(sum(p_retailprice), 6) as total from part group by 1, 2
union all select 'matrix', (row // 256)::int, count(*), round(sum(val), 6) from coo group by 1, 2""",
    "generated_by_name": f"""with s as (select i, 100 - 20 + 2 * ({draw("'s-' || i")} % 20) as size from range(50) t(i)),
o as (select i, size, coalesce(sum(size) over (order by i rows between unbounded preceding and 1 preceding), 0) as off from s)
select '/data/input1' as path, off::bigint as off, (case when i = 49 then 5000 else least(off + size, 5000) end - off)::bigint as len from o where off < 5000""",
    "index_manifest": """with o as (select c_nationkey::varchar as index, c_mktsegment as path, strlen(c_name) + 1 as len,
  coalesce(sum(strlen(c_name) + 1) over (partition by c_mktsegment order by c_custkey rows between unbounded preceding and 1 preceding), 0) as off from customer)
select index, path, count(*) as n_segments, sum(len)::bigint as bytes, min(off)::bigint as first_off, max(off)::bigint as last_off from o group by index, path""",
    "transition_matrix": f"with {MAT} select src, dst, round(p, 12) as p from mat",
    "out_degree": f"with {EDGES} select src, count(*) as deg from edges group by src",
    "symmetric_edges": f"with {EDGES} select src, dst from edges union all select dst, src from edges where src <> dst",
    "neighbour_sets": f"with {EDGES} select node, count(*) as n, sum(other)::bigint as sum_other from (select dst as node, src as other from edges union select node, node from nodes) t group by node",
    "dangling_nodes": f"with {EDGES} select node from nodes where node not in (select src from edges)",
    "words_counted": "select word, count(*) as n from (select unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) as word from documents) t where word <> '' group by word",
    "udtf_tokens": """with w as (select string_split_regex(text, '[ \\t\\n\\r\\f]') as l from conversations),
p as (select unnest(l) as word, unnest(range(len(l))) as pos from w)
select word, count(*) as n, sum(pos)::bigint as places from p where word <> '' group by word""",
    "collected_values": f"with {EDGES} select src, string_agg(dst::varchar, ',' order by dst) as dsts from edges group by src",
    "pagerank_step": ranks(1) + " select node, round(rank, 10) as rank from r1",
    "convergence_test": R + " select round(max(abs(a.rank - b.rank)), 10) as moved, round(max(abs(a.rank - b.rank)), 10) <= 1e-6 as converged from r9 a join r10 b on a.node = b.node",
    "rank_min_max": R + " select round(min(rank), 10) as min_rank, round(max(rank), 10) as max_rank from r10",
    "rank_histogram": R + """, e as (select node, round(rank, 10) as rank from r10), m as (select min(rank) as lo, max(rank) as hi from e)
select (case when hi > lo then least(floor(1000 * (rank - lo) / (hi - lo)) + 1, 1000) else 1 end)::int as bin, count(*) as n from e, m group by 1""",
    "rank_top": R + f" select * from ({FINAL}) t order by rank desc, node limit 10",
    "pagerank_sub_grid": ranks(5, "dst % 4 < 2 and src % 3 < 2") + " select node, round(rank / 7, 12) as rank_7th from r5",
    "block_assign_mod": blocks("row % 4", "col % 4", "row // 4", "col // 4"),
    "block_assign_range": blocks("row // 16", "col // 16", "row % 16", "col % 16"),
    "block_sizes": "select b::int as b, (n // 7 + case when b < n % 7 then 1 else 0 end)::bigint as size from (select count(*) as n from part) t, range(7) r(b)",
    "block_pack_roundtrip": f"with {COO} select (row // 64)::int as brow, (col // 64)::int as bcol, count(*) as n, round(sum(val), 9) as total from coo group by 1, 2",
    "vector_pack_roundtrip": "select p_partkey as node, p_retailprice as v from part",
    "gimv_sum": f"with {COO} select row as node, round(sum(val * p_retailprice), 6) as v from coo join part on col = p_partkey group by row",
    "gimv_min": f"with {EDGES} select node, min(v) as v from (select dst as node, src as v from edges union all select node, node from nodes) t group by node",
    "gimv_min_fixpoint": f"""with recursive {EDGES.replace(" as materialized", " as")}, both_ways as (select src as a, dst as b from edges union select dst, src from edges),
reach as (select node, node as v from nodes union select b.b, r.v from reach r join both_ways b on r.node = b.a where r.v < b.b)
select node, min(v) as v from reach group by node""",
    "gimv_or": hops(2, 1) + " select node, b0, b1 from h1",
    "gimv_bits": """with s as (select s_suppkey, s_acctbal, md5(s_suppkey || '-0') || md5(s_suppkey || '-1') as hex from supplier),
cell as (select s_suppkey as brow, s_suppkey // 16 as b, k // 16 as r, k % 16 as i from s, range(256) t(k)
  where ((('0x' || substr(hex, (k // 8 * 2 + 1)::int, 2))::int >> (k % 16 % 8)::int) & 1) = 1),
vec as (select s_suppkey // 16 as b, s_suppkey % 16 as i, s_acctbal as v from supplier)
select brow as b, r::int as i, round(sum(v), 4) as v from cell join vec using (b, i) group by 1, 2 having sum(v) <> 0""",
    "diag_scale": "select p_partkey as node, round(p_retailprice * (1.0::double / (p_size - 1)), 8) as v from part where p_size <> 1 and p_retailprice <> 0",
    "matmul_blocks": MATMUL,
    "matmul_broadcast": MATMUL,
    "matmul_folders": f"select i, j, count(*) as n, round(sum(v), 3) as total from ({MATMUL}) t group by i, j",
    "sliding_dot": """with e as (select event_id as pos, trunc(value)::int as val from events), n as (select count(*) as n from e), q as (select n_nationkey as pos, n_regionkey * 7 - 13 as val from nation),
s as (select k as step, sum(q.val * x.val)::bigint as s from range((select ceil((n - 25) / 16.0)::bigint from n)) t(k), q, e x where x.pos = k * 16 + q.pos group by k)
select step, ((((s + 128) % 256 + 256) % 256) - 128)::int as v from s""",
    "pair_all": "select n_nationkey::bigint as l_id, r_regionkey::bigint as r_id from nation, region",
    "pair_half": "select a.n_nationkey::bigint as l_id, b.n_nationkey::bigint as r_id from nation a join nation b on a.n_nationkey <= b.n_nationkey",
    "pair_block_equi": f"with {EDGES} select distinct (dst % 4)::int as l_brow, (src % 4)::int as l_bcol, (src % 4)::int as r_b from edges",
    "pair_sides": entries("id % 16") + PAIR_COUNT.format(on="a.id % 2 = 0 and b.id % 2 = 1 and a.grp < b.grp"),
    "pair_diag_block": entries("ntile(16) over (order by id)") + PAIR_COUNT.format(on="a.grp = b.grp"),
    "pair_circular_block": entries("(row_number() over (order by id) - 1) % 16") + PAIR_COUNT.format(on="a.grp = b.grp"),
    "pair_shuffled_block": entries("ntile(16) over (order by md5('b-' || id), id)") + PAIR_COUNT.format(on="a.grp = b.grp"),
    "pair_random": entries("0") + PAIR_COUNT.format(on=f"{draw("'p-' || a.id || '-' || b.id")} < {int(0.2 * 2**32)}"),
    "join_table": PARTNERS + " select seg, count(*) as partners, sum(partner)::bigint as sum_partner from partners group by seg",
    "pair_task_count": PARTNERS + " select count(*) as n_tasks from pair",
    "partner_groups": PARTNERS.replace("with ", "with recursive ", 1).replace(" as materialized", " as") + """, sz as (select seg, count(*) as size from partners group by seg),
near as (select x.seg as a, y.seg as b from partners x join partners y on x.partner = y.partner and x.seg <> y.seg join sz sx on x.seg = sx.seg join sz sy on y.seg = sy.seg
  group by 1, 2 having count(*) / max(greatest(sx.size, sy.size))::double > 0.3),
reach as (select seg, seg as grp from sz union select n.b, r.grp from reach r join near n on r.seg = n.a where r.grp < n.b)
select seg, min(grp) as grp from reach group by seg""",
    "partner_overlap": PARTNERS + """, sz as (select seg, count(*) as size from partners group by seg)
select x.seg as a, y.seg as b, count(*) as shared, round(count(*) / max(greatest(sx.size, sy.size))::double, 9) as ratio
from partners x join partners y on x.partner = y.partner and x.seg < y.seg join sz sx on x.seg = sx.seg join sz sy on y.seg = sy.seg group by 1, 2""",
    "largest_group": PARTNERS + """, c as (select seg, count(*) as partners from partners group by seg)
select seg % 8 as grp, seg, partners from (select *, row_number() over (partition by seg % 8 order by partners desc, seg) as k from c) t where k = 1""",
    "segment_cover": COVER + " select * from cover",
    "segment_cover_batch": COVER + " select path, remaining, count(*) as n from cover group by path, remaining",
    "cover_hull": SEGS + """ select id, path, off, len, (off // 64 * 64)::bigint as cover_off,
  (case when (off + len) % 64 = 0 and off + len > off // 64 * 64 then off + len else ((off + len) // 64 + 1) * 64 end - off // 64 * 64)::bigint as cover_len from s""",
    "segment_names": SEGS + " select id, '/d/' || path || '#EOP#' || off || '-' || len as name, '/d/' || path as path, off, len from s",
    "segment_order": SEGS + " select id, path, row_number() over (partition by path order by off, len, id) as place from s",
    "locality_hit_rate": lru(4),
    "locality_hit_rate_unpacked": lru(1),
    "locality_random": scheduled("drawn"),
    "locality_first": scheduled("best"),
    "local_read_rate": f"""with {NATION_PAIRS}, {HOSTS}, {SCHEDULES}, ways as (select 'random' as scheduler, * from drawn union all select 'local', * from best),
items as (select scheduler, worker, l as item from ways union all select scheduler, worker, r from ways)
select scheduler, count(*) as reads, count(host) as local from items left join hosts on hosts.item = items.item and host = worker group by scheduler""",
    "task_metadata": f"""with {NATION_PAIRS}, {HOSTS}, {packs(4)}, t as (select k, l, r from q join k using (pr, pc)), items as (select k, l as item from t union select k, r from t)
select k as task, k % 3 as worker, any_value(n) as pairs, count(distinct items.item) as items, count(distinct host) as n_hosts
from items left join hosts using (item) join (select k, count(*) as n from t group by k) c using (k) group by k""",
    "capacity_packs": f"""with {ENTRIES}, s as (select id, size, sum(size) over (order by id) - size as ahead, sum(size) over () // 4 // 2 as half from e), v as (select id, size, (ahead // half)::bigint as pack from s)
select a.pack as pr, b.pack as pc, count(*) as n, sum(a.size + b.size)::bigint as bytes from v a join v b on a.id <= b.id group by 1, 2""",
    "best_group": COVER + """, g as (select id % 50 as grp, id, remaining from cover),
ug as (select 'all' as part, grp, remaining, sum(remaining) over (partition by grp order by remaining, id) as used from g union all select 'left', grp, remaining, sum(remaining) over (partition by grp order by remaining, id) from g where remaining > 0),
n as (select part, grp, sum((remaining = 0)::int)::bigint as perfect, sum((used <= 2000)::int)::bigint as fit from ug group by part, grp),
best as (select part, arg_min(grp, (-perfect, grp)) as p, max(perfect) as np, arg_min(grp, (-fit, grp)) as f, max(fit) as nf from n group by part)
select case when np > 0 then p else f end as grp, case when np > 0 then 'perfect' else 'fit' end as how, case when np > 0 then np else nf end as n from best where np > 0 or nf > 0""",
    "segment_lookup": SEGS + """, q as (select id, path, off, len + id % 2 as len from s)
select q.id, q.path, (select count(*) from s where s.path = q.path and (s.off < q.off or (s.off = q.off and s.len < q.len)))::bigint as place, exists (select 1 from s where s.path = q.path and s.off = q.off and s.len = q.len) as found from q""",
    "segment_cover_lists": COVER.replace("as off, (1 + o_orderkey * 13 % 97) * 5 as len from orders)", "as off, (1 + o_orderkey * 13 % 97) * 5 as len from orders where (o_custkey % 20) <> 3)").replace("1 + l_partkey * 17 % 97 as len from lineitem)", "1 + l_partkey * 17 % 97 as len from lineitem where l_partkey % 20 <> 4 and (l_partkey % 20 <> 3 or (l_orderkey * 104729 + l_linenumber * 1299709 + l_suppkey * 31) % 1000000 < 500000))")
    + """, have as (select distinct path from r), every as (select path from have union select path from t)
select path, case when count(cover.path) = 0 then -1 when not bool_or(path in (select path from have)) then 0 else count(*) end as n,
case when count(cover.path) = 0 or not bool_or(path in (select path from have)) then -1 else min(remaining) end::bigint as least, count(cover.path) = 0 as none
from every left join cover using (path) group by path""",
    "segment_hosts": SEGS + """, b as (select p::varchar as path, k as block, (p * 7 + k * 3) % 11 as host from range(20) a(p), range(82) c(k)),
e as (select distinct id, path, x as block from (select id, path, unnest([off // 64, (off + len) // 64]) as x from s) t)
select host, count(*) as n, sum(id)::bigint as ids from (select distinct id, host from e join b using (path, block)) t group by host""",
    "scan_bytes": "select count(*) as n, sum(strlen(text))::bigint as bytes from documents",
    "fm_init": f"with {EDGES}, {fm(K)} select node, {', '.join(f'b{i}' for i in range(K))} from h0",
    "fm_hop1": hops(K, 1) + " select * from h1",
    "fm_functions": hops(2, 1) + f" select node, {zero('b0')}::int as z0, {zero('b1')}::int as z1, lower(to_hex(b0)) as hex0, b0 as back0, round({estimate(2)}, 6) as nh from h1",
    "nh_curve": CURVE + " select hop, round(nh, 6) as nh from curve",
    "status_counts": CURVE + " select hop, converged, changed from curve",
    "node_radius": RADIUS + " select node, max_radius, eff_radius from radius",
    "radius_histogram": RADIUS + " select floor(eff_radius + 0.5)::int as radius, count(*) as n from radius group by 1",
    "effective_diameter": CURVE + f""", x as (select hop, nh, lag(nh) over (order by hop) as prev, 0.9::double * (select nh from curve where hop = {HOPS}) as lim from curve)
select round(coalesce((select hop - 1 + (lim - prev) / (nh - prev) from x where hop > 0 and nh >= lim order by hop limit 1), -1.0::double), 6) as diameter""",
    "average_diameter": CURVE + ", x as (select hop, nh - lag(nh) over (order by hop) as gain from curve) select round(sum(hop * gain) / sum(gain), 6) as diameter from x",
    "node_radius_block": WALK_RADIUS + " select node, max_radius, eff_radius from radius",
    "nh_curve_converged": WALK_CURVE + " select hop, round(nh, 6) as nh from curve",
    "status_counts_converged": WALK_CURVE + " select hop, converged, changed from curve",
    "node_radius_converged": WALK_RADIUS + " select node, max_radius, eff_radius from radius",
    "radius_histogram_converged": WALK_RADIUS + " select floor(eff_radius + 0.5)::int as radius, count(*) as n from radius group by 1",
    "effective_diameter_converged": WALK_CURVE + """, x as (select hop, nh, lag(nh) over (order by hop) as prev, 0.9::double * (select arg_max(nh, hop) from curve) as lim from curve)
select round(coalesce((select hop - 1 + (lim - prev) / (nh - prev) from x where hop > 0 and nh >= lim order by hop limit 1), -1.0::double), 6) as diameter""",
    "average_diameter_converged": WALK_CURVE + ", x as (select hop, nh - lag(nh) over (order by hop) as gain from curve) select round(sum(hop * gain) / sum(gain), 6) as diameter from x",
    "nh_exact": f"with {EDGES}, p0 as (select node, node as far from nodes), " + ", ".join(f"p{h} as materialized (select node, far from p{h - 1} union select node, dst from p{h - 1} join edges on far = src)" for h in range(1, 5)) + " " + " union all ".join(f"select {h} as hop, count(*) as n from p{h}" for h in range(5)),
    "bitshuffle_roundtrip": hops(4, 1) + " select node, b0, b1, b2, b3 from h1",
}
_STEPS = 40
ORACLES["pagerank_converged"] = (
    ranks(_STEPS)
    + ", step as ("
    + " union all ".join(f"select {i} as k, max(abs(a.rank - b.rank)) as moved from r{i - 1} a join r{i} b on a.node = b.node" for i in range(1, _STEPS + 1))
    + "), last as (select min(k) as k from step where moved <= 1e-4::double) select node, round(rank, 10) as rank from ("
    + " union all ".join(f"select {i} as k, * from r{i}" for i in range(1, _STEPS + 1))
    + ") t where k = (select k from last)"
)
for _name in ("pagerank_10", "pagerank_range_block", "pagerank_mod_block", "pagerank_rect_block", "pagerank_secondary_sort"):
    ORACLES[_name] = f"{R} {FINAL}"
