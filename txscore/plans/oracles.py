"""DuckDB SQL for the queries of plans.queries."""

from __future__ import annotations

from txscore import config as C

_D = range(C.DIM)


def _quant(x: str) -> str:
    return f"cast(case when isnan(({x})::double) then 0 when ({x}) <= -1 then -10000 when ({x}) <= 0 then 0 when ({x}) >= 1 then 10000 else round(({x}) * 10000) end as integer)"


def _clamp(x: str) -> str:
    return f"(case when ({x}) < 0 then 0.0 when ({x}) > 1 then 1.0 else ({x}) end)::double"


_MCC = "(case mcc " + " ".join(f"when '{k}' then {v}::double" for k, v in C.MCC_RISK.items()) + f" else {C.DEFAULT_MCC_RISK}::double end)"
_CODES = "[" + ", ".join(f"'{c}'" for c in [*C.MCC_RISK, "9999"]) + "]"

_TX = f"""
base as (select event_id, user_id, event_type, ts, cast(round(value * 100) as bigint) cents, cast(json_extract_string(props, '$.k') as integer) k, epoch_us(ts) us from events),
win as (select *, k % 20 m,
  sum(cents) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) sum_before,
  count(*) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) n_before,
  count(*) over (partition by user_id order by us range between 86400000000 preceding and current row) tx_count_24h,
  count(*) over (partition by user_id, k % 20 order by us, event_id rows between unbounded preceding and 1 preceding) n_same,
  lag(us) over (partition by user_id order by us, event_id) last_us, lag(cents) over (partition by user_id order by us, event_id) last_cents from base),
shop as (select k % 20 m, sum(cents)::double * 25.0::double / (count(*) * 100.0::double) merchant_avg from base group by 1),
tx as (select event_id, user_id, cents, cents * 25.0::double / 100.0::double amount, 1 + k % 12 installments,
  case when n_before > 0 then sum_before::double / n_before::double * 25.0::double / 100.0::double else 0.0::double end avg_amount, tx_count_24h,
  n_same = 0 unknown_merchant, ({_CODES})[k % 11 + 1] mcc, merchant_avg, event_type in ('click', 'view') is_online, event_type = 'purchase' card_present,
  ((event_id * 37) % 1200)::double km_from_home, hour(ts) h, isodow(ts) - 1 wd, us // 60000000 mins, last_us is not null has_last, last_us // 60000000 last_mins,
  abs(cents - last_cents) * 3.0::double / 100.0::double last_km, case when event_type = 'error' then 1 else 0 end label from win join shop using (m))"""
_F = [
    _clamp("amount / 10000.0::double"),
    _clamp("installments / 12.0::double"),
    f"(case when avg_amount > 0 then {_clamp('amount / avg_amount / 10.0::double')} else 1.0::double end)",
    "(h / 23.0::double)",
    "(wd / 6.0::double)",
    f"(case when has_last then {_clamp('(mins - last_mins) / 1440.0::double')} else -1.0::double end)",
    f"(case when has_last then {_clamp('last_km / 1000.0::double')} else -1.0::double end)",
    _clamp("km_from_home / 1000.0::double"),
    _clamp("tx_count_24h / 20.0::double"),
    "(case when is_online then 1.0::double else 0.0::double end)",
    "(case when card_present then 1.0::double else 0.0::double end)",
    "(case when unknown_merchant then 1.0::double else 0.0::double end)",
    _MCC,
    _clamp("merchant_avg / 10000.0::double"),
]
_VEC = _TX + ",\nvec as (select event_id, " + ", ".join(f"{_quant(f)} q{d}" for d, f in enumerate(_F)) + ", label from tx)"
_KEY = "cast((case when q5 >= 0 then 1 else 0 end) + (case when q9 > 0 then 2 else 0 end) + (case when q10 > 0 then 4 else 0 end) + (case when q11 > 0 then 8 else 0 end) + 16 * (case when q12 <= 2047 then 0 when q12 <= 4095 then 1 when q12 <= 6143 then 2 else 3 end) + (case when q2 > 4096 then 64 else 0 end) + (case when q8 > 2048 then 128 else 0 end) as integer)"
_KEYED = _VEC + f",\nkeyed as (select *, {_KEY} pk from vec)"
_BOX = _KEYED + ",\nboxes as (select pk, count(*) n, bit_or(1 << label)::integer mask, " + ", ".join(f"min(q{d}) l{d}, max(q{d}) h{d}" for d in _D) + " from keyed group by pk)"
_WIDE = "list_position([" + ", ".join(f"h{d} - l{d}" for d in _D) + "], list_max([" + ", ".join(f"h{d} - l{d}" for d in _D) + "]))::integer - 1"


def _dist(a: str, b: str, n: int = C.DIM) -> str:
    return " + ".join(f"({a}.q{d} - {b}.q{d})::bigint * ({a}.q{d} - {b}.q{d})::bigint" for d in range(n))


_SYN = (
    "syn as (select i, "
    + ", ".join(
        f"cast(case when {'i & 3 = 0' if d in (5, 6) else f'i & {bit} != 0' if (bit := {9: 1, 10: 2, 11: 4}.get(d)) else 'false'} then {'-10000' if d in (5, 6) else '10000'} else (i * 313 + {d} * 1009) % 10001 end as integer) q{d}"
        for d in _D
    )
    + " from range(4096) t(i))"
)
# d2, ref_id and label in one number, whose five smallest an aggregate keeps
_TOP = _VEC + f""",
near as (select a.event_id query_id, min((({_dist("a", "b")}) * 1048576 + b.event_id) * 2 + b.label, 5) top from vec a join vec b on a.event_id != b.event_id group by 1),
knn as (select query_id, i::integer rank, (top[i] // 2) % 1048576 ref_id, (top[i] // 2) // 1048576 d2, (top[i] % 2)::integer as label from (select *, unnest(range(1, len(top) + 1)) i from near))"""
_VOTE = f"with {_TOP} select query_id, sum(label)::integer fraud_count, sum(label) / 5.0::double fraud_score, sum(label) < 3 approved from knn group by 1"
_BOXES = f", keyed as (select *, {_KEY} pk from vec), boxes as (select pk, count(*) n, bit_or(1 << label)::integer mask, " + ", ".join(f"min(q{d}) l{d}, max(q{d}) h{d}" for d in _D) + " from keyed group by pk)"
_GAP = " + ".join(f"greatest(l{d} - q{d}, q{d} - h{d}, 0)::bigint * greatest(l{d} - q{d}, q{d} - h{d}, 0)::bigint" for d in _D)
_OWN = f""", own as (select a.event_id query_id, min((({_dist("a", "b")}) * 1048576 + b.event_id) * 2 + b.label, 5) top from keyed a join keyed b on a.event_id != b.event_id and a.pk = b.pk group by 1),
taken as (select query_id, case when len(own.top) = 5 and (own.top[5] // 2) // 1048576 <= {C.EARLY_STOP} then own.top else near.top end as top from near left join own using (query_id))"""


def _leaves(turns: int = 10) -> str:
    """Leaves halved at exact medians; more turns than partitions of the test tables need."""
    values = "[" + ", ".join(f"q{d}" for d in _D) + "]"
    box = ", ".join(f"min(q{d}) l{d}, max(q{d}) h{d}" for d in _D)
    out = [_KEYED, "x0 as (select *, pk::bigint leaf from keyed)"]
    for k in range(turns):
        out.append(f"b{k} as (select leaf, n, {_WIDE} dim from (select leaf, count(*) n, {box} from x{k} group by leaf))")
        out.append(f"p{k} as (select x{k}.*, n, row_number() over (partition by leaf order by {values}[dim + 1], event_id) - 1 place from x{k} join b{k} using (leaf))")
        out.append(f"x{k + 1} as (select * exclude (leaf, n, place), case when n > {C.LEAF_SIZE} then 2 * leaf + 256 + (place >= n // 2)::bigint else leaf end leaf from p{k})")
    return "with " + ",\n".join(out) + f" select leaf, count(*) n, bit_or(1 << label)::integer mask, {box} from x{turns} group by leaf"


# as _TOP, with a query among its own neighbours
_ALL = _VEC + f""",
near as (select a.event_id query_id, min((({_dist("a", "b")}) * 1048576 + b.event_id) * 2 + b.label, 5) top from vec a cross join vec b where a.event_id % 8 > 3 group by 1),
counted as (select event_id query_id, event_id % 8 > 3 valid, coalesce(list_sum(list_transform(top, lambda t: t % 2)), 0) n from vec left join near on query_id = event_id)"""
_JSON_OUT = """'{"approved":' || (case when n < 3 then 'true' else 'false' end) || ',"fraud_score":' || (n / 5.0::double)::varchar || '}'"""

ORACLES = {
    "quantize_amount": "select o_orderkey, cast(case when o_totalprice / 10000.0::double <= 0 then 0 when o_totalprice / 10000.0::double >= 1 then 10000 else round(o_totalprice / 10000.0::double * 10000) end as integer) q0 from orders",
    "feature_ratio": "select o_orderkey, " + _quant("case when c_acctbal > 0 then (case when o_totalprice / c_acctbal / 10.0::double > 1 then 1.0::double else o_totalprice / c_acctbal / 10.0::double end) else 1.0::double end") + " q2 from orders left join customer on o_custkey = c_custkey",
    "feature_time": f"with {_TX} select event_id, mins epoch_minutes, h::integer as hour, wd::integer as weekday, {_quant(_F[3])} q3, {_quant(_F[4])} q4 from tx",
    "feature_last_tx": f"with {_TX} select event_id, {_quant(_F[5])} q5, {_quant(_F[6])} q6 from tx",
    "feature_velocity": f"with {_TX} select event_id, tx_count_24h, {_quant(_F[8])} q8 from tx",
    "feature_known_merchant": f"with {_TX} select event_id, {_quant(_F[11])} q11 from tx",
    "feature_mcc_risk": f"with {_TX} select event_id, mcc, {_quant(_F[12])} q12 from tx",
    "features_real": f"with {_TX} select event_id, " + ", ".join(f"round({f}, 9) f{d}" for d, f in enumerate(_F)) + " from tx",
    "mcc_table_1024": "select p_partkey, case (p_partkey * 7) % 1024 " + " ".join(f"when {int(k) % 1024} then {round(v * 10000)}" for k, v in C.MCC_RISK.items()) + " else 5000 end::integer risk from part",
    "tx_vector": f"with {_VEC} select * from vec",
    "partition_key": f"with {_KEYED} select event_id, pk from keyed",
    "partition_bounds": f"with {_BOX} select pk, n, " + ", ".join(f"l{d}, h{d}" for d in _D) + " from boxes",
    "label_mask": f"with {_BOX} select pk, mask from boxes",
    "widest_dim": f"with {_BOX} select pk, {_WIDE} dim from boxes",
    "median_split": f"with {_BOX}, wide as (select pk, n, {_WIDE} dim from boxes), v as (select event_id ref_id, pk, n, dim, [" + ", ".join(f"q{d}" for d in _D) + "][dim + 1] v from keyed join wide using (pk)) select ref_id, pk, dim, case when row_number() over (partition by pk order by v, ref_id) - 1 < n // 2 then 0 else 1 end as side from v",
    "box_lower_bound": f"with {_BOX} select event_id, b.pk, " + " + ".join(f"greatest(l{d} - q{d}, q{d} - h{d}, 0)::bigint * greatest(l{d} - q{d}, q{d} - h{d}, 0)::bigint" for d in _D) + " bound from keyed join boxes b on keyed.pk != b.pk",
    "l2_distance": f"with {_VEC}, pairs as (select event_id, lag(event_id) over (order by event_id) prev from vec) select p.event_id, {_dist('a', 'b')} d2 from pairs p join vec a on a.event_id = p.event_id join vec b on b.event_id = p.prev",
    "knn_top5": f"with {_TOP} select * from knn",
    "knn_vote": _VOTE,
    "knn_vote_blocks": _VOTE,
    "embedding_knn": "with v as (select vec_id, list_transform(embedding, lambda x: cast(round(x::double * 10000) as bigint)) e, label from embeddings), near as (select a.vec_id query_id, min((list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint * 65536 + b.vec_id), 5) top from v a join v b on a.vec_id != b.vec_id group by 1) select query_id, i::integer rank, top[i] % 65536 ref_id, top[i] // 65536 d2 from (select *, unnest(range(1, len(top) + 1)) i from near)",
    "synthetic_vectors": f"with {_SYN} select * from syn",
    "json_payload_parse": f"with {_TX} select event_id, true valid, round(amount, 9) amount, installments::bigint installments, tx_count_24h, mcc, is_online, card_present, round(km_from_home, 9) km_from_home, mins epoch_minutes, h::integer as hour, wd::integer weekday, has_last, coalesce(last_mins, 0) last_minutes from tx",
    "fraud_response_json": f"select n, {_JSON_OUT} response from range(6) t(n)",
    "stream_score": f"with {_TOP} select query_id, sum(label)::integer fraud_count, sum(label) / 5.0::double fraud_score, sum(label) < 3 approved from knn group by 1",
    "knn_approximate": f"with {_TOP}{_BOXES}{_OWN} select query_id, i::integer rank, (top[i] // 2) % 1048576 ref_id, (top[i] // 2) // 1048576 d2, (top[i] % 2)::integer as label from (select *, unnest(range(1, len(top) + 1)) i from taken)",
    "index_leaves": _leaves(),
    "probe_stats": f"with {_TOP}{_BOXES}, fifth as (select query_id, max(d2) filter (rank = 5) d5, sum(label) v from knn group by 1), each as (select query_id, v, count(*) c from fifth join keyed on event_id = query_id join boxes on boxes.pk = keyed.pk or {_GAP} <= d5 group by 1, 2) select c partitions_visited, count(*) queries, sum(v)::bigint votes from each group by 1",
    "index_append": f"with {_BOX} select pk, n, mask, " + ", ".join(f"l{d}, h{d}" for d in _D) + " from boxes",
    "payload_edges": f"with {_TX}, odd as (select *, event_id % 10 o, event_id % 10 not in (1, 2, 3, 4, 7, 9) valid from tx) select event_id, valid, case when valid then case when o = 5 then 0 else installments end end::bigint installments, case when valid then has_last and o != 8 end has_last, case when valid then not unknown_merchant end as known from odd",
    "known_merchant": "with m as (select event_id, event_id % 20 j, 'MERC-' || lpad((cast(json_extract_string(props, '$.k') as integer) % 20)::varchar, 3, '0') id from events) select event_id, j not in (7, 8) and (id = 'MERC-' || lpad(j::varchar, 3, '0') or j % 3 = 0) as known from m",
    "score_json": f"with {_ALL} select query_id, valid, n::integer fraud_count, n / 5.0::double fraud_score, n < 3 approved, {_JSON_OUT} response from counted",
    "reference_json": f"with {_VEC} select label, count(*) n, " + ", ".join(f"sum(q{d})::bigint q{d}" for d in _D) + " from vec group by label",
    "index_counts": f"with {_BOX} select (select count(*) from vec) points, (select sum(label) from vec)::bigint fraud, (select count(*) from boxes) partitions",
}
